import pytest
from pyspark.sql import functions as F

from colloquy import queries as Q
from colloquy.functions import shifts as S
from colloquy.functions import text as T


def values(spark, expression, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_white_space_of_all_kinds_collapses(spark):
    assert values(spark, T.norm_text, [" A  B \tc\x1c", None, "  "]) == ["a b c", "", ""]


def test_queries_that_say_nothing_are_null(spark):
    assert values(spark, T.clean_query, [" red  shoe ", "None", "NULL ", " ", None]) == ["red shoe", None, None, None, None]


def test_prices_stop_at_the_thousands_comma(spark):
    assert values(spark, T.parse_price, ["$1,299.00", "from $ 3 to $4.50", "free", None]) == [1.0, 4.5, None, None]


def test_brand_from_the_title(spark):
    assert values(spark, lambda c: T.infer_brand(F.lit(None), F.lit(" "), c), ["Blue Sky Home Goods - lamp", ": x", None, ""]) == ["Blue Sky Home", None, None, None]


def test_colour_is_a_substring(spark):
    assert values(spark, lambda c: T.infer_color(c, F.lit(None), F.lit(None).cast("array<string>")), ["Tailored", "teal and black", "plain"]) == ["red", "black", None]


def test_category_tokens(spark):
    assert values(spark, T.normalize_category, ["Women's Shoes & Accessories › Bodies", "gas", None]) == ["women shoe accessory body", "gas", ""]


def test_instruction_ends_at_the_first_marker_after_its_start(spark):
    assert values(spark, T.instruction_from_text, ["x Instruction: find a lamp [SEP] Search", "Instruction: Search lamps", "none"]) == ["find a lamp", "Search lamps", ""]


@pytest.mark.parametrize(("raw", "n"), [('{"n": 1}', "1"), ('```json\n{"n": 2}\n```', "2"), ('Here: {"n": 3} done', "3"), ('{"n": 4} } {', None), ("[1]", None), ('{"n":5}] x [', "5"), ("", None), (None, None)])
def test_json_in_model_output(spark, raw, n):
    assert values(spark, lambda c: F.get_json_object(T.extract_json(c), "$.n"), [raw]) == [n]


def test_constraint_names_and_values(spark):
    assert values(spark, T.constraint_key, [" Max-Price ", "Item  Type", "a__b_"]) == ["budget_max", "category", "a_b"]
    assert values(spark, lambda c: T.constraint_value(F.lit("budget_max"), c), ["under $1,200.50", "unknown", "cheap"]) == ["1200.5", None, None]


def test_aliases_of_conditions_and_categories(spark):
    assert values(spark, S.alias_condition, ["Preference-Change", "real world", "odd", None]) == ["user_preference", "real_world_feasibility", "none", "none"]
    assert values(spark, S.alias_category, ["scope(entity) correction", "Override", "x"]) == ["scope_correction", "override", "none"]


def test_relaxed_values(spark):
    assert values(spark, lambda c: S.relax_value(F.lit("budget_max"), c), ["30", "33.3", None, "red"]) == ["37.5", "41.63", None, None]
    assert values(spark, lambda c: S.is_relaxation(F.lit("size_min"), F.lit("10"), c), ["9", "11", None]) == [True, False, True]


def test_values_take_the_form_of_the_old_one(spark):
    assert values(spark, lambda c: S.coerce_value(F.lit("n"), c, F.lit("5")), ["7.0", "7.5", " many ", "none"]) == ["7", "7.5", "many", None]
    assert values(spark, lambda c: S.coerce_value(F.lit("gift"), c, F.lit("true")), ["No", "yes"]) == ["false", "true"]


def test_numbers_in_sentences(spark):
    assert values(spark, S.format_value, ["30.0", "2.50", "red", None]) == ["30", "2.5", "red", "no preference"]


def test_typed_values_keep_their_types(spark):
    from colloquy.functions import shifts as S

    cases = [
        ("size", '"9.50"', '"9"', '"9.50"'),  # a text stays a text, whatever it looks like
        ("size", '" 9.50 "', "9", "9.5"),
        ("size", '"9.0"', "9", "9"),
        ("size", '"nine"', "9", '"nine"'),
        ("size", "4", "9.5", "4.0"),
        ("budget_max", '" 40 "', '"30"', "40.0"),
        ("budget_max", '"cheap "', "null", '"cheap "'),
        ("gift", '"No"', "true", "false"),
        ("gift", '"perhaps"', "false", "true"),
        ("gift", "0", "true", "false"),
        ("color", '" red "', '"blue"', '"red"'),
        ("color", '" Null "', '"blue"', None),
        ("color", "null", "5", None),
        ("color", "[1]", '"blue"', "[1]"),
    ]
    df = spark.createDataFrame(cases, "field string, value string, old string, want string")
    made = F.to_json(S.coerce_variant(F.col("field"), F.parse_json("value"), F.parse_json("old")))
    assert [(r.field, r.value, r.old, r.made) for r in df.withColumn("made", made).collect()] == cases
    pairs = [("a_max", "10", "12.5", True), ("a_max", "10", "9", False), ("a_min", "10", "9", True), ("a", '"x"', "null", True), ("a", "null", "null", False), ("a", '"9"', '"9"', False), ("a", '"9"', "9", True)]
    df = spark.createDataFrame(pairs, "field string, old string, new string, want boolean")
    assert [r.got for r in df.withColumn("got", S.is_variant_relaxation(F.col("field"), F.parse_json("old"), F.parse_json("new"))).collect()] == [p[3] for p in pairs]


def test_strip_and_json_of_answers_as_written_out(spark):
    spaces = [chr(n) for n in range(1, 0x10000) if not 0xD800 <= n < 0xE000]
    rows = [(c, f"{c}a{c}b{c}{c}", n) for n, c in enumerate(spaces)]
    df = spark.createDataFrame(rows, "c string, t string, n int")
    whole = F.regexp_replace("t", rf"^{T.SPACE}|{T.SPACE}$", "")
    assert df.where(~T.strip(F.col("t")).eqNullSafe(whole)).count() == 0
    texts = {'{"a": 1}': '{"a": 1}', 'Well: {"a": 1}.': '{"a": 1}', '[{"a": 1}]': None, '"x {}"': None, "```json\n{}\n```": "{}", '{} {}': None, "tell {\"b\": 2}": '{"b": 2}', "": None, None: None, "12": None, "nulls {}": "{}", '{"a": 1} and more': '{"a": 1}'}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.extract_json(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in got} == texts


def test_what_wishes_are_compared_with_is_made_before_pairs(spark):
    plan = Q.evaluated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "regexp" not in above and "regexp" in plan
