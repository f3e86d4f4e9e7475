import json
import random

from pyspark.sql import functions as F

from colloquy.operators import candidates as C
from colloquy.operators import constraints as K
from colloquy.operators import intentions as I
from colloquy.operators import pages, rerank, search, steps
from colloquy.plans import bulk


def thirty(spark):
    return spark.createDataFrame([(1, i, f"B{i:09d}", i) for i in range(1, 31)], "request_id int, place int, asin string, rank int")


def reversed_rows(spark, n=10):
    return spark.createDataFrame([(1, i, f"b{31 - i:09d}", str(i)) for i in range(1, n + 1)], "request_id int, pos int, asin string, new_rank string")


def test_compact_limits(spark):
    item = spark.range(1).select(F.struct(F.lit("A").alias("asin"), F.lit(3).alias("rank"), F.lit("t").alias("title"), F.lit(1.0).alias("price"), F.lit("").alias("product_category"), F.lit("c").alias("category"), F.lit("q").alias("query"), F.array_repeat(F.lit("a"), 20).alias("attributes"), F.create_map().cast("map<string,array<string>>").alias("options"), F.lit("b").alias("brand"), F.array_repeat(F.repeat(F.lit("x"), 400), 5).alias("bullet_points"), F.repeat(F.lit("d"), 900).alias("description")).alias("candidate"))
    plain = C.compact_candidates(item).first()["compact"].asDict()
    assert len(plain["bullet_points"]) == 3 and len(plain["bullet_points"][0]) == 240 and len(plain["attributes"]) == 12
    assert "description" not in plain and plain["product_category"] == "c" and plain["original_rank"] == 3
    assert len(C.compact_candidates(item, True).first()["compact"]["description"]) == 300


def test_model_order_keeps_original_ranks(spark):
    good, failed = rerank.apply_rerank(reversed_rows(spark), thirty(spark))
    rows = good.orderBy("pos").collect()
    assert failed.count() == 0 and len(rows) == 10
    assert (rows[0]["original_rank"], rows[0]["rerank_rank"], rows[9]["original_rank"]) == (30, 1, 21)


def test_rows_are_cut_before_they_are_validated(spark):
    extra = spark.createDataFrame([(1, 11, "unknown", "11")], "request_id int, pos int, asin string, new_rank string")
    good, failed = rerank.apply_rerank(reversed_rows(spark).union(extra), thirty(spark))
    assert failed.count() == 0 and good.count() == 10


def test_one_bad_row_fails_the_request(spark):
    for bad in ("unknown", "B000000030"):
        extra = spark.createDataFrame([(1, 5, bad, "")], "request_id int, pos int, asin string, new_rank string")
        out = rerank.rerank_or_fallback(reversed_rows(spark, 4).union(extra), thirty(spark)).orderBy("pos").collect()
        assert [r["original_rank"] for r in out] == list(range(1, 11)) and {r["fallback"] for r in out} == {"bm25_top10"}


def test_a_missing_list_falls_back_and_an_empty_one_does_not(spark):
    none = reversed_rows(spark).limit(0)
    missing = spark.createDataFrame([(1,)], "request_id int")
    assert rerank.rerank_or_fallback(none, thirty(spark), 10, missing).count() == 10
    assert rerank.rerank_or_fallback(none, thirty(spark), 10).count() == 0


def test_fewer_rows_than_asked_for_are_a_success(spark):
    good, failed = rerank.apply_rerank(reversed_rows(spark, 2), thirty(spark))
    assert good.count() == 2 and failed.count() == 0


def test_zero_as_new_rank_gives_the_position(spark):
    rows = spark.createDataFrame([(1, 1, "B000000002", "0"), (1, 2, "B000000001", "x")], "request_id int, pos int, asin string, new_rank string")
    assert [r["rerank_rank"] for r in rerank.apply_rerank(rows, thirty(spark))[0].orderBy("pos").collect()] == [1, 2]


def dialogue(spark):
    first = spark.createDataFrame([("d", "color", "red"), ("d", "budget_max", "30.0"), ("d", "size", None)], "instance_id string, field string, value string")
    shifts = spark.createDataFrame([("d", 0, "override", "color", "blue", "why", ["size", "Color"]), ("d", 1, "relax", "color", None, "", []), ("d", 2, "none", None, None, "", []), ("d", 3, "add", "brand", "Acme", "", ["brand"])], "instance_id string, turn_id int, op string, field string, value string, rationale string, priority_update array<string>")
    return first, shifts


def test_shifts_give_states_and_deltas(spark):
    first, shifts = dialogue(spark)
    state = {(r["turn_id"], r["field"]): r["value"] for r in I.fold_intentions(first, shifts).collect()}
    assert state[0, "color"] == "blue" and state[1, "color"] is None and (3, "color") in state
    assert state[3, "brand"] == "Acme" and (2, "brand") not in state and (2, "size") in state
    deltas = {(r["turn_id"], r["field"]): (r["old"], r["new"]) for r in I.shift_deltas(first, shifts).collect()}
    assert deltas == {(0, "color"): ("red", "blue"), (1, "color"): ("blue", None), (3, "brand"): (None, "Acme")}


def test_priority_is_folded_in_order(spark):
    first, shifts = dialogue(spark)
    start = spark.createDataFrame([("d", ["color", "budget_max", "size"], ["budget_max"])], "instance_id string, fields array<string>, priority array<string>")
    rows = I.fold_priority(start, shifts).orderBy("turn_id").collect()
    assert rows[0]["old"] == ["budget_max", "color", "size"] and rows[0]["new"] == ["size", "color", "budget_max"]
    assert rows[2]["op"] == "none" and rows[3]["new"] == ["brand", "size", "color", "budget_max"]


def test_timeline_has_earlier_turns_then_the_current_one(spark):
    turns = spark.createDataFrame([("d", i, f"i{i}", "") for i in range(7)], "instance_id string, turn_id int, intention string, delta string")
    last = I.intention_timeline(turns).where("turn_id = 6").first()["timeline"]
    assert [(t["turn_id"], t["is_current"]) for t in last] == [("2", False), ("3", False), ("4", False), ("5", False), ("current", True)]


def test_missing_and_null_wishes_differ_from_unknown_values(spark):
    rows = spark.createDataFrame([(1, [("budget_max", "10"), ("color", "Red "), ("size", "9"), ("brand", None), ("odd", "x"), ("category", "the")])], "id int, constraints array<struct<field:string,value:string>>")
    item = rows.withColumns({"price": F.lit(10.0), "color": F.lit(" red"), "category": F.lit("shoe"), "title": F.lit("t")})
    result = {c: F.col(c) for c in ("price", "color", "category", "title")}
    out = K.evaluate_constraints(item, result).first()
    assert out["satisfied"] == ["budget_max", "color"] and out["violated"] == ["category"]
    assert {c["field"]: c["matched"] for c in out["checks"]} == {"budget_max": True, "color": True, "size": None, "category": None}


def trace(spark, actions):
    schema = "instance_id int, turn_id int, step_index int, action_type string, action_payload map<string,string>, page_type string, selected_asin string, result_asin string, selected_options map<string,string>, visible_asins array<string>, title string, price double, satisfied array<string>, status string, env_done boolean, all_satisfied boolean, ready boolean"
    return spark.createDataFrame([(1, 1, i, a, {"query": q}, "results", None, None, {}, v, "", None, [], "observed", False, False, False) for i, (a, q, v) in enumerate(actions, 1)], schema)


def test_repeats_and_stalls_stop_a_turn(spark):
    made = steps.stagnant_steps(steps.repeat_streak(steps.made_progress(steps.state_changed(trace(spark, [("search", "a", ["x"]), ("search", " A ", ["y"]), ("search", "b", ["z"])])))))
    rows = steps.stop_reasons(made).orderBy("step_index").collect()
    assert [r["stop_reason"] for r in rows] == [None, "stuck"]
    made = steps.stagnant_steps(steps.repeat_streak(steps.made_progress(steps.state_changed(trace(spark, [("search", c, ["x"]) for c in "abcd"])))))
    assert [(r["stagnant_steps"], r["stop_reason"]) for r in steps.stop_reasons(made).orderBy("step_index").collect()] == [(0, None), (1, None), (2, "stuck")]


def test_visible_items_are_scanned_greedily(spark):
    text = "Page 1 [SEP] B00000000A [SEP] one [SEP] $1.50 [SEP] B00000000B [SEP] two [SEP] none [SEP] B00000000C [SEP] three [SEP] $3"
    got = spark.range(1).select(pages.visible_items(F.lit(text), F.lit("results")).alias("v")).first()["v"]
    assert [(i["asin"], i["price"]) for i in got] == [("B00000000A", 1.5), ("B00000000C", 3.0)]
    assert spark.range(1).select(pages.no_results(F.lit("Total results: 0"))).first()[0]


def test_click_targets_feed_fallback_actions(spark):
    text = "Page 1 [SEP] B00000000A [SEP] B00000000B [SEP] $1.50 [SEP] $2 [SEP] B00000000C [SEP] three [SEP] $3"
    raw = spark.createDataFrame([(text, ["b00000000a", "next >"], False), ("WebShop [SEP] Search", ["search"], False)], "raw_text string, clickables array<string>, done boolean")
    seen = raw.withColumn("visible_items", pages.visible_items(F.col("raw_text"), F.lit("results"), F.col("clickables")))
    items = seen.first()["visible_items"]
    assert [(i["asin"], i["title"], i["click_target"]) for i in items] == [("B00000000A", "B00000000B", "b00000000a"), ("B00000000C", "three", "B00000000C")]
    action = "struct<action_type:string,payload:map<string,string>>"
    page = seen.withColumns({"action": F.lit(None).cast(action), "utterance": F.lit(" red lamp "), "page_type": F.when(F.size("visible_items") > 0, "results").otherwise("search"), "options": F.create_map().cast("map<string,array<string>>"), "selected_options": F.create_map().cast("map<string,string>")})
    got = {tuple(sorted(r["next_action"]["payload"].items())) for r in pages.fallback_actions(page).collect()}
    assert got == {(("target", "b00000000a"),), (("query", "red lamp"),)}


def test_the_last_utterances_only_are_held(spark):
    turns = [("d", i, "user" if i % 3 else "assistant", "  " if i == 7 else f"u{i}", "now" if i == 11 else f"u{i}") for i in range(12)]
    got = {r["turn_id"]: r["context"] for r in I.utterance_context(spark.createDataFrame(turns, "instance_id string, turn_id int, role string, text string, current string"), 3).collect()}
    for i in range(12):
        said = [t[3] for t in turns[: i + 1] if t[2] == "user" and t[3].strip()]
        now = turns[i][4]
        assert got[i] == (said if said and said[-1] == now else [*said, now])[-3:]


def test_rows_without_a_prompt_stay(spark):
    class Echo:
        def generate(self, prompt):
            return prompt.upper()

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, prompt string")
    got = {r["id"]: (r["output"], r["error"]) for r in bulk.bulk_generate(rows, Echo).collect()}
    assert got == {1: ("A", None), 2: (None, "no prompt"), 3: ("A", None)}


class Mover:
    """A shopper that wants another colour, then a brand."""

    def generate(self, prompt):
        if "how your wishes change" in prompt:
            if '\\"value\\":\\"blue' not in prompt:
                return json.dumps({"intention_changed": True, "category": "override", "op": "override", "field": "color", "value": "blue", "rationale": "r"})
            return json.dumps({"intention_changed": True, "category": "add", "op": "add", "field": "brand", "value": "Acme", "priority_update": ["brand"], "rationale": "r"})
        if "gold_search_query" in prompt and "search query" in prompt:
            return json.dumps({"gold_search_query": "blue lamp"})
        return "Another one, please."


def test_rounds_go_on_from_each_other(spark):
    fields = ["Title", "name", "Price", "category", "product_category", "query", "brand_name", "Description", "full_description"]
    item = ["Red lamp", None, "$20", "lamp", "lamp", "lamp", "Acme", "d", None]
    extra = {"pricing": "array<double>", "BulletPoints": "array<string>", "Attributes": "array<string>", "options": "map<string,array<string>>"}
    cat = spark.createDataFrame([(1, "B000000001", *item)], "row_id long, asin string, " + ", ".join(f"{c} string" for c in fields)).withColumns({k: F.lit(None).cast(v) for k, v in extra.items()})
    posted = search.postings(cat.select(F.col("row_id").alias("doc_id"), F.col("Title").alias("text")))
    start = spark.createDataFrame([(1, 0, "red lamp", [("category", "lamp"), ("color", "red")], ["color"], "a lamp")], "instance_id long, turn_id int, query string, constraints array<struct<field:string,value:string>>, priority array<string>, request string")
    state, seen = start, []
    for _ in range(2):
        round_ = bulk.stored(bulk.advance_round(state, posted, cat, Mover, max_turns=1))
        row = round_.first()
        seen.append((row["turn_id"], row["query"], [tuple(c) for c in row["next_constraints"]], row["next_priority"], row["next_query"], row["ended"]))
        state = bulk.next_round(round_)
    assert seen[0] == (0, "red lamp", [("category", "lamp"), ("color", "blue")], ["color", "category"], "blue lamp", False)
    # An update can only name fields that were known before the shift, so the new one comes last.
    assert seen[1] == (1, "blue lamp", [("category", "lamp"), ("color", "blue"), ("brand", "Acme")], ["color", "category", "brand"], "blue lamp", True)
    assert state.count() == 0


def test_search_finds_what_a_plain_scan_finds(spark):
    rng = random.Random(4)
    voc = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(voc, k=rng.randint(1, 30)))) for i in range(300)] + [(400, None), (401, "")]
    asked = [(i, " ".join(rng.choices(voc, k=rng.randint(1, 12)))) for i in range(40)] + [(50, None), (51, "zzz"), (52, "the The of"), (53, "of the")]
    posted = search.postings(spark.createDataFrame(docs, "doc_id long, text string").where("text is not null"))
    impact = {(r["term"], r["doc_id"]): r["impact"] for r in posted.collect()}
    got = {}
    for r in search.search_topk(spark.createDataFrame(asked, "query_id long, query string"), posted, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["doc_id"]))
    for key, text in asked:
        words = set((text or "").lower().split())
        score = {}
        for (term, doc), n in impact.items():
            if term in words:
                score[doc] = score.get(doc, 0) + n
        best = sorted((-n, doc) for doc, n in score.items())[:5]
        assert sorted(got.get(key, [])) == [(i + 1, *x) for i, x in enumerate(best)]


class Shopper:
    def generate(self, prompt):
        if "too easily satisfied" in prompt:
            return json.dumps({"intention_changed": True, "category": "relax", "field": "Budget Max", "rationale": "not available"})
        if "how your wishes change" in prompt:
            return json.dumps({"intention_changed": False})
        raise TimeoutError("busy")


def test_unchanged_answers_are_asked_again_and_failures_fall_back(spark):
    turns = spark.createDataFrame([(1, 0, "[]", "{}", {"budget_max": "30"}, ["budget_max"], [], "lamp", None)], "instance_id long, turn_id int, timeline string, feedback string, constraints map<string,string>, fields array<string>, priority array<string>, request string, stored_query string")
    shift = bulk.bulk_shifts(turns, Shopper, retry_share=1.1)
    row = shift.first()
    assert (row["op"], row["field"], row["value"], row["condition"]) == ("relax", "budget_max", "37.5", "real_world_feasibility")
    assert bulk.bulk_shifts(turns, Shopper, retry_share=0.0).first()["op"] == "none"
    said = bulk.bulk_utterances(shift, Shopper).first()
    assert said["utterance"] in ("It doesn't have to be exactly budget max.", "budget max can be a bit flexible.", "Close is fine.")
    asked = spark.createDataFrame([("{}", None, None, "lamp", "red", None, None, "x")], "intention string, delta string, stored_query string, category string, color string, brand string, size string, request string")
    assert bulk.bulk_queries(asked, Shopper).first()["gold_search_query"] == "lamp red"


def test_instructions_become_intentions(spark):
    class Model:
        def generate(self, prompt):
            return '```json\n{"constraints": {"Max Price": "$1,200", "color": "none", "size_exact": "9", "Item Type": "lamp"}, "priority": ["product_type", "x"]}\n```'

    rows = spark.createDataFrame([("Instruction: a lamp",), ("  ",)], "instruction string")
    out = {r["request"]: r["intention"] for r in bulk.bulk_initial_intentions(rows, Model).collect()}
    got = out["a lamp"]
    assert {c["field"]: c["value"] for c in got["constraints"]} == {"budget_max": "1200.0", "category": "lamp"}
    assert got["priority"] == ["category", "budget_max"] and got["gold_search_query"] == "lamp" and out[""] is None
    assert bulk.bulk_initial_intentions(rows).collect()[0]["intention"]["gold_search_query"] == "a lamp"
