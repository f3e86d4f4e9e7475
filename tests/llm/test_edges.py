"""Clashing names, extreme ids, very long texts, hot groups and the forms that only large tables take."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

repeats = pytest.importorskip("colloquy.llm.repeats")
import corpus_pipeline  # noqa: E402
from colloquy.llm import bpe, jaccard, langid, mixing, quality, shared, substring, suffix, tiff, urls, warc  # noqa: E402
from colloquy.llm import queries as Q  # noqa: E402
from tests.llm.test_text_operators import plain, samples  # noqa: E402
from tests.oracle import SF_DIR  # noqa: E402

CLASHES = ("TEXT", "text_key", "key", "nth", "spans", "name", "n", "copies", "bucket", "Doc_Id", "component", "chunk", "c0")


def clashing(df):
    """Columns that differ from an operator's in case only, or are called like those it might make for itself."""
    return df.toDF(*df.columns).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    voc = ["the", "of", "and", "house", "river", "green", "walks", "over", "old", "town", "bridge", "night", "day", "singing", "birds"]
    say = lambda k: " ".join(rng.choices(voc, k=k))
    rows = [(i, say(90) + ".", rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a", 1), (101, rows[0][1] + " x", "en", "a", 1), (102, None, "en", "a", 0), (103, "", None, None, 0), (None, say(70), "de", "b", 1), *[(104, say(80), "en", "b", 1)] * 2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)


OPERATORS = {
    "langid": lambda d: langid.identify(d).select("doc_id", "held_out", "lang_pred"),
    "quality": quality.quality_rules,
    "tiff": lambda d: tiff.media_digests(tiff.write_media(d)),
    "bpe": lambda d: bpe.encode_documents(d, *Q.tokenizer()),
    "mixing": mixing.mix_sources,
    "substring": substring.remove_repeated_words,
    "jaccard": lambda d: jaccard.jaccard_groups(d).select("doc_id", "n_shingles", "component_id"),
    "suffix": suffix.remove_repeated_bytes,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(docs, name):
    assert rows_of(OPERATORS[name](clashing(docs))) == rows_of(OPERATORS[name](docs)) != []


def test_other_columns_of_pages_change_nothing(spark):
    page = spark.createDataFrame([(i, f"http://a.{('com', 'net/es', 'org')[i % 3]}/{i % 7}", f"x{i % 4}") for i in range(40)] + [(None, None, None)], "page_id long, url string, html string")
    more = page.select("*", *[F.lit(1).alias(c) for c in ("URL", "Html", "verdict", "rule", "chunk", "fold", "key", "sha1", "winner", "seconds", "host", "gram")])
    assert rows_of(urls.filter_urls(more, Q.URL_RULES)) == rows_of(urls.filter_urls(page, Q.URL_RULES))
    assert rows_of(warc.capture_histories(more).select("page_id", "payload_digest", "refers_to")) == rows_of(warc.capture_histories(page).select("page_id", "payload_digest", "refers_to"))


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_all_columns(spark, docs, at):
    name, stage = corpus_pipeline.STAGES[at]
    given = clashing(docs)
    out = stage(spark, given, None)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == given.columns and out.count()
        # the first columns are what they are without the others, and the others are untouched
        own = out.toDF(*[f"x{i}" for i in range(len(out.columns))])
        assert rows_of(own.select(*own.columns[:5])) == rows_of(stage(spark, docs, None))
        assert {tuple(r) for r in own.select(*own.columns[5:]).distinct().collect()} == {tuple(f"own {c}" for c in CLASHES)}
    else:
        assert rows_of(out) == rows_of(stage(spark, docs, None))
    assert stage(spark, docs.limit(0), None).count() == 0


def test_captures_of_any_id(spark):
    ids = [2**63 - 1, -(2**63), 10**12, -5, 0, None]
    page = spark.createDataFrame([(i, "http://a.com/", "same") for i in ids], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.capture_histories(page).collect()}
    assert set(got) == set(ids) and got[2**63 - 1]["record_type"] == "response" and got[-5]["refers_to"] == 2**63 - 1


def test_the_merge_spills_and_keeps_order(monkeypatch):
    monkeypatch.setattr(warc, "BUFFER_ROWS", 50)
    monkeypatch.setattr(warc, "READ_ROWS", 7)
    monkeypatch.setattr(warc.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 9)}", f"{rng.randint(0, 5)}", rng.choice([None, rng.randint(-9, 9)]), 1, "d", "response", None, f"run {i % 23}", i, 1) for i in range(400)]
    rows.sort(key=lambda r: (r[7], warc._key(r)))
    batches = list(warc._batches_of(rows, warc.pa.schema(warc._INDEX), 33))
    got = [tuple(r.values()) for b in warc._merge(batches) for r in b.to_pylist()]
    assert [g[-1] for g in got] == list(range(400)) and {g[-2] for g in got} == {3}
    assert [warc._key(g) for g in got] == sorted(map(warc._key, rows)) and sorted(map(str, (g[:-2] for g in got))) == sorted(map(str, rows))


def test_urls_of_one_fold_are_calibrated_on_all(spark):
    rows = [(i, f"http://good.com/{w}") for i, w in enumerate(["abc", "abd", "abe"])] + [(10 + i, f"http://x.net/es/{w}") for i, w in enumerate(["zzq", "zzy", "zzx"])] + [(20, "http://y.org/abf"), (21, "http://y.org/es/zzw")]
    page = spark.createDataFrame(rows, "page_id long, url string")
    decided = page.where(F.col("page_id") < 20).where(F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)) == 0)
    got = {r["page_id"]: r for r in urls.filter_urls(page, Q.URL_RULES).collect()}
    assert decided.count() < 6 and got[20]["score"] > got[21]["score"]
    assert got[20]["verdict"] == "allow" and got[21]["verdict"] == "block"


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("most", [None, 3])
def test_long_texts_hot_groups_and_sketches_that_stay_tables(spark, words, most):
    rng = random.Random(7)
    size = 9 if words else 12
    letter = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    long = " ".join(letter(5) for _ in range((shared.STEP_BYTES + 70_000) // 6))
    passage = " ".join(letter(3) for _ in range(20))
    rows = [(i, f"{letter(9)} {letter(9)} {passage} {letter(9)}") for i in range(300)]  # one passage over 256 times
    # a stretch across the place where the long text is cut, one whole text, and a run of one unit
    rows += [(500, long), (501, "q " + long[shared.STEP_BYTES - 4000 : shared.STEP_BYTES + 4000] + " q"), (502, "x " * 900), (503, None), (504, "")]
    df = spark.createDataFrame([*rows, *samples(1, "abc ", 60)], "doc_id long, text string").repartition(3)
    got = substring.remove_repeated_words(df, size, most=most) if words else suffix.remove_repeated_bytes(df, size, most=most)
    assert rows_of(got) == plain([*rows, *samples(1, "abc ", 60)], size, words)


def test_all_that_a_long_repeated_text_holds_is_found(spark):
    rows = [(1, "ab" * 40_000), (2, "ab" * 3000), (3, "c" + "ab" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix.remove_repeated_bytes(df, 40)) == plain(rows, 40, False)


def test_long_texts_in_quality_rules_and_joins(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(shared.STEP_BYTES // 4)]
    long, n = " ".join(words) + "\n" + "z" * (shared.STEP_BYTES + 10), len(words) + 1
    df = spark.createDataFrame([(1, long, "en"), (2, long.upper(), "en"), (3, "a b", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == n and got[1]["word_chars"] == sum(map(len, words)) + shared.STEP_BYTES + 10
    joined = {r["doc_id"]: r for r in jaccard.jaccard_groups(df).collect()}
    shingles = {tuple(w) for w in zip(*((words + ["z" * (shared.STEP_BYTES + 10)])[k:] for k in range(5)))}
    assert joined[1]["n_shingles"] == len(shingles) and joined[2]["component_id"] == 1 and joined[3]["component_id"] == 3


def test_parts_of_long_texts_are_joined(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(public.path("byte_bpe_50k.json")), random.Random(5)
    texts = ["a" * 5000, " " * 3000 + "x", "word " * 700 + "<|endoftext|>" + "1234567" * 300, "".join(rng.choices("ab '.\n12é漢", k=6000)), "short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df, *Q.tokenizer(), digests=False, part=500).collect()}
    assert all(got[i] == whole.encode(t or "", add_special_tokens=False).ids for i, t in enumerate([*texts, texts[0]]))


def test_small_languages_are_compared_with_all(spark):
    rng = random.Random(2)
    voc = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(voc, k=200)), "en") for i in range(60)] + [(100, " ".join(rng.choices(voc, k=200)), "xx"), (101, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(200)), "xx")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[0] and got[100] and not got[101]


def twins(length):
    """A word of Thue and Morse over two letters and its complement: any polynomial modulo 2 ** 64 gives them one hash once they are long."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("length", [16, 64, 256, 1024, 4096])
def test_words_that_polynomials_confuse_are_told_apart(spark, length):
    x, y = twins(length)
    p, q = twins(16)
    common = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([x, *common])), (2, " ".join([y, *common])), (3, f"{x} {x} {x} q r s"), (4, f"{y} {y} {y} q r s"), (5, f"{x} p q {y} p q"), (6, f"{p} {q} {q} {p}"), (7, f"{q} {p} {p} {q}")], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring.remove_repeated_words(docs, 35).collect()}
    assert set(removed.values()) == {0}
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
    # documents 1 and 2 share all shingles but the first: 30 of 32
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [1, 3, 4, 5, 6, 7]
    rules = quality.quality_rules(docs.withColumn("lang", F.lit("en")))
    repeats_of = {r.doc_id: r.n_repeat_words for r in rules.collect()}
    assert {repeats_of[i] for i in (1, 2, 5, 6, 7)} == {0}
    # windows of words and of bytes that are built the same way, also where every group goes by names
    words = spark.createDataFrame([(1, " ".join(x[:64])), (2, " ".join(y[:64]))], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeated_words(words, 64).collect()] == [0, 0]


@pytest.mark.parametrize("hot", [3, 1])
def test_byte_windows_that_polynomials_confuse_are_told_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    x, y = twins(512)
    rows = [(i, t) for i, t in enumerate([x, y, "z" + x[:300], "z" + y[:300]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = 260
    counts = Counter(t[i : i + size] for _, t in rows for i in range(len(t) - size + 1))
    want = {}
    for key, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        want[key] = sum(gone)
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeated_bytes(docs, size).collect()} == want


def test_predictions_do_not_depend_on_partitioning(spark):
    docs = Q.table(spark, SF_DIR, "documents")
    docs = docs.unionByName(docs.limit(40).withColumn("doc_id", F.col("doc_id") + 10**6))
    scores = [rows_of(langid.identify(docs.repartition(n, "doc_id"))) for n in (1, 3, 7)]
    assert scores[0] == scores[1] == scores[2]
    text_of = {r.doc_id: r.text for r in docs.collect()}
    by_text = {}
    for r in scores[0]:
        by_text.setdefault(text_of[r[0]], set()).add(r[2:])
    assert all(len(v) == 1 for v in by_text.values())


def test_urls_learn_from_few_blocked_ones(spark):
    words = "one two three four five six seven eight nine ten".split()
    allowed = [f"http://www.example.com/en/{a}/{b}" for a in words for b in words[:3]]
    # blocked urls that all fall into one fold
    many = [f"http://shop.net/fr/casino-{i}-win-{i * 7}" for i in range(400)]
    folds = spark.createDataFrame([(u,) for u in many], "url string").select("url", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)).alias("fold")).collect()
    blocked = [r.url for r in folds if r.fold == 0][:5]
    others = ["http://x.org/casino-3-win-9", "http://y.org/casino-12-win-84"] + [f"http://z.org/en/{w}/{w}" for w in words]
    page = spark.createDataFrame(list(enumerate(allowed + blocked + others)), "page_id long, url string")
    got = {r.url: r for r in urls.filter_urls(page, Q.URL_RULES).join(page, "page_id").collect()}
    assert {got[u].verdict for u in blocked} == {"block"} and {got[u].verdict for u in allowed} == {"allow"}
    assert [got[u].verdict for u in others] == ["block"] * 2 + ["allow"] * 10
    assert len({got[u].score for u in others}) > 5
    # one kind only: nothing to compare
    only = urls.filter_urls(page.where(~F.col("url").contains("/fr/")), Q.URL_RULES).collect()
    assert {(r.verdict, r.score) for r in only} == {("allow", 0.0)}


def test_fold_for_the_threshold():
    assert urls.held_fold([(0, "allow", 3), (1, "allow", 1)]) is None and urls.held_fold([]) is None
    assert urls.held_fold([(0, "allow", 3), (1, "allow", 1), (1, "block", 1)]) == urls.ALL_FOLDS
    assert urls.held_fold([(0, "allow", 3), (1, "allow", 1), (1, "block", 1), (2, "block", 1)]) == 1
