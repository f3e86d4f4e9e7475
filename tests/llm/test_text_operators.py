import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("colloquy.llm.bpe")
import corpus_pipeline  # noqa: E402
from colloquy.llm import jaccard, mixing, quality, repeats, sketch, substring, suffix  # noqa: E402
from colloquy.llm import queries as Q  # noqa: E402
from tests.oracle import SF_DIR, both  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, Q.QUERIES[name], Q.ORACLE_SQL[name])
    assert ours == theirs and ours


def samples(seed, alphabet, length):
    """Texts made of shared pieces, with nulls, empty texts, copies and repeated rows."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(0, length))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 20) :][: rng.randint(10, length)] + "".join(rng.choices(alphabet, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    return [*rows, (100, None), (101, ""), *[(102, rows[0][1])] * 2, (103, rows[0][1]), (104, "a" * 300), (None, "ab" * 150)]


def plain(rows, size, words):
    units = [WORD.findall(t or "") if words else (t or "").encode() for _, t in rows]
    window = (lambda u, i: tuple(u[i : i + size])) if words else (lambda u, i: u[i : i + size])
    counts = Counter(window(u, i) for u in units for i in range(len(u) - size + 1))
    out = []
    for (key, _), u in zip(rows, units):
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if counts[window(u, i)] > 1:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(u, gone) if not g]
        if words:
            out.append((key, len(u), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        else:
            spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            out.append((key, len(u), sum(gone), spans, hashlib.sha256(bytes(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [3, 1])
@pytest.mark.parametrize(("words", "size", "alphabet"), [(False, 12, "abcdé "), (False, 20, "ab"), (True, 9, "abcdé  \n"), (True, 8, "a b ")])
def test_repeated_windows_are_all_found(spark, monkeypatch, hot, words, size, alphabet):
    monkeypatch.setattr(repeats, "HOT", hot)  # 1: every group goes the way of large ones
    rows = samples(size, alphabet, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("TEXT2", F.lit(1)).repartition(3)
    got = substring.remove_repeated_words(df, size) if words else suffix.remove_repeated_bytes(df, size)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, size, words)


def test_counts_of_one_flush_reach_every_level():
    times = {11: 1, 12: 2, 13: 16, 14: 255, 15: 256, 16: 5000}
    keys = np.repeat(np.array(list(times), np.uint64), list(times.values()))
    table = np.zeros(2 << sketch.LEAST_BITS >> 2, np.uint8)
    size = (1 << sketch.BLOCK_BITS) // 4
    for batch in sketch._merge(sketch._parts([keys], 2, sketch.LEAST_BITS)):
        for r in batch.to_pylist():
            table[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    levels = sketch.Levels(SimpleNamespace(value=(table.tobytes(), 2, sketch.LEAST_BITS)))
    assert levels.of(np.array(list(times), np.uint64)).tolist() == [0, 1, 2, 2, repeats.HOT, repeats.HOT]


@pytest.mark.parametrize("size", [suffix.WINDOW, corpus_pipeline.PASSAGE_BYTES])
def test_planted_passages_go_exactly_where_they_fill_a_window(spark, size):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 55, 60, 90)]
    passages += ["".join(rng.choices("qrst ", k=n)) for n in (size - 1, size, size + 1)]
    rows = [(2 * i + k, f"{i}{k}" + " ".join(word() for _ in range(80)) + f"{k}{p}{k}" + word()) for i, p in enumerate(passages) for k in (0, 1)]
    rows += [(100 + i, " ".join(word() for _ in range(150))) for i in range(6)]
    got = sorted((tuple(r) for r in suffix.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size).collect()), key=str)
    assert got == plain(rows, size, False)
    removed = {r[0]: r[2] for r in got}
    assert all(removed[2 * i + k] == (len(p) if len(p) >= size else 0) for i, p in enumerate(passages) for k in (0, 1))
    assert 51 < len(passages[0]) < suffix.WINDOW and not any(removed[100 + i] for i in range(6))


def test_no_window_in_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeated_words(df).count() == suffix.remove_repeated_bytes(df).count() == 0


def shopping(seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(60)]
    base = [[rng.choice(voc) for _ in range(rng.randint(6, 60))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(voc).upper()
        rows.append((i, " ".join(words + rng.choice(base) * (rng.random() < 0.2))))
    return [*rows, (900, None), (901, ""), (902, "a b c"), (903, "A  b c"), (904, "a b"), (905, rows[0][1]), (None, rows[0][1]), (905, rows[0][1])]


def test_components_are_those_of_all_pairs(spark):
    rows = shopping(3)
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g and r[0] is not None) for g in set(group)}
    want = sorted(((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group)), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_groups(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = jaccard.one_of_each(df)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(set(least.values()), key=str) and kept.columns == df.columns
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_a_large_component_is_split_over_tasks(spark):
    """Sets of one component get its smallest id in several tasks, also where a row for each set is dealt out by component."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(600)] + [(1000 + i, f"a{i} b c d e f{i}") for i in range(100)]
    small = {"coalescePartitions.enabled": "false", "autoBroadcastJoinThreshold": "-1", "advisoryPartitionSizeInBytes": "1k", "skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.2"}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"} | {f"spark.sql.adaptive.{k}": v for k, v in small.items()}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        groups = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        got = {r["doc_id"]: r["component_id"] for r in groups.collect()}
        plan = groups._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}
    assert re.search(r"SortMergeJoin\(skew=true\) \[root#", plan), plan


def test_targets_reshare_what_full_sources_leave():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 100})
    assert got["a"] == 20 and got[None] <= 200 and abs(sum(got.values()) - 1.5 * 2110) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_rows_without_an_id_are_dealt_out_and_chosen_by_their_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    tables, real = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df: tables.append(real(df)) or tables[-1])
    # ten rows of one id besides, which only their texts tell apart
    rows = [(None, f"a t{i}", "web") for i in range(1000)] + [(7, f"b t{i}", "web") for i in range(10)] + [(2000 + i, "c d", "x") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [sorted((r.text, r.source) for r in mixing.mixed_documents(docs.repartition(n, by)).collect()) for n, by in ((1, "text"), (5, "text"), (3, "source"))]
    assert taken[0] == taken[1] == taken[2] and 0 < len(taken[0]) < 2 * len(rows)
    keyed = next(t for t in tables if "bucket" in t.columns)
    assert keyed.groupBy("source", "size", "bucket").count().agg(F.max("count")).first()[0] < 120


def test_knapsack_comes_as_near_as_can_be():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 5)))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and (lengths * take).sum() <= budget
        assert (lengths * take).sum() == max(s for s in sums if s <= budget)
    lengths, counts = np.array([40, 100]), np.array([3, 3])
    assert [int((lengths * mixing.fit(lengths, counts, b)).sum()) for b in (200, 300, 419, 420)] == [200, 300, 380, 420]
    lengths, counts = np.arange(1, 400), np.full(399, 30)
    for budget in (100_000, 777_777, 1_000_001):  # over FINE, so that the proportional part is taken first
        take = mixing.fit(lengths, counts, budget)
        assert (lengths * take).sum() == budget and (take <= counts).all() and take.min() >= counts.min() * (budget - mixing.FINE) // (lengths * counts).sum()


def test_the_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", None])) for i in range(300)]
    rows += [(7, None, "a"), (8, "", "z"), (9, "x", "a"), (9, "x", "a"), (None, "y y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    first, again = (sorted((tuple(r) for r in mixing.mix_sources(d).collect()), key=str) for d in (df, df.repartition(5)))
    assert first == again and len(first) == len(rows)
    taken, target = Counter(), {}
    for _, source, size, _, goal, copies in first:
        taken[source] += size * copies
        target[source] = goal
        assert copies <= 2
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert mixing.mixed_documents(df).count() == sum(r[5] for r in first)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_quality_counts(spark):
    text = "a b c a b c\n\nxé xé xé #%\na b c a b c\n \n \n"
    df = spark.createDataFrame([(1, text, "en"), (2, None, None), (3, "", "en"), (1, text, "en"), (None, "x", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    r = rows[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) == (16, 20, 2, 1, 12, False)
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and quality.quality_rules(df).count() == 5
    assert quality.quality_rules(df.limit(0)).count() == 0 and quality.kept_documents(df).count() == 0


def test_divergence():
    assert quality.divergence(np.array([1.0, 0]), np.array([0, 3.0])) == 1 and quality.divergence(np.array([2.0, 2]), np.array([3.0, 3])) == 0


def test_encoding_is_the_librarys(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    codec, rng = bpe.Codec(*Q.tokenizer()), random.Random(6)
    parts = ["a" * 300, " " * 200, "\n\n \t", "0123456789" * 30, "!'=-" * 50, "'section'llama're'really", "<|endoftext|>", "漢字日本語" * 40, "\u00a0\u3000 ", "\x1c\x85", "don't we'll", "!!!'s", "é\u0301ß", "\U0001f600\u200d"]
    for _ in range(800):
        monkeypatch.setattr(bpe, "LEAF", rng.choice([4, 8, 16, 64, 256]))
        text = "".join(rng.choice([rng.choice(parts), "".join(map(chr, rng.choices(range(32, 0x2FFF), k=rng.randint(1, 40)))), "".join(rng.choices("ab '.\n12", k=30))]) for _ in range(rng.randint(0, 8)))
        ids = bpe.encode([text], codec)[0]
        want = whole.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and codec.decode(ids).decode() == text == whole.decode(want, skip_special_tokens=False)


def test_encoded_digests(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "hello world")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.encode_documents(df, *Q.tokenizer()).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0 and rows[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[3]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest() and rows[3].asDict() | {"doc_id": 4} == rows[4].asDict()


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, SF_DIR))
        assert kept.columns == docs.columns and kept.schema["n_chars"] == docs.schema["n_chars"]
    good = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} <= good
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() == kept.count() and out.where("n_tokens > 0").count() > 0
