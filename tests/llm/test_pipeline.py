"""Each stage of the pipeline against a plain version over the same input."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

oracle = pytest.importorskip("colloquy.llm.oracle")
import corpus_pipeline  # noqa: E402
from colloquy.llm import mixing  # noqa: E402
from tests.oracle import SF_DIR  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.execute(sql).fetchall()


def without_repeats(texts, size):
    """Texts without the bytes of windows that start in two places."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for t, r in zip(texts, raw):
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if counts[r[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(None if t is None else bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore"))
    return out


def best_sum(sizes, budget):
    """The largest total of some of the sizes that is not over budget."""
    sums = 1
    for n in sizes:
        sums |= sums << n
    return (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_every_stage_does_what_a_plain_version_does(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    added = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000)
    edges = added.withColumn("text", F.lit(None).cast("string")).unionByName(added.withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(added.withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.lit("")))
    inputs = [corpus_pipeline.stored(docs.unionByName(edges))]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(corpus_pipeline.stored(stage(spark, inputs[-1], SF_DIR)))
    start, good, single, cut, mixed, tokens = inputs
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in inputs]

    assert ids[1] == sorted(r[0] for r in by_sql(start, f"select doc_id from ({oracle.QUALITY}) where kept")) and len(ids[1]) < len(ids[0])

    assert ids[2] == sorted({r[0] for r in by_sql(good, f"select component_id from ({oracle.JACCARD})")}) and len(ids[2]) < len(ids[1])

    before = single.orderBy("doc_id").select("doc_id", "text").collect()
    after = {r["doc_id"]: r["text"] for r in cut.select("doc_id", "text").collect()}
    plain = without_repeats([r["text"] for r in before], corpus_pipeline.PASSAGE_BYTES)
    assert after == {r["doc_id"]: t for r, t in zip(before, plain)} and any(r["text"] != t for r, t in zip(before, plain))

    rows = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in cut.collect()}
    size, taken, copies = Counter(), Counter(), Counter(ids[4])
    for key, (source, n) in rows.items():
        size[source] += n
        taken[source] += copies[key] * n
    for source, goal in mixing.targets(dict(size)).items():
        passes = min(int(goal // size[source]), 2) if size[source] else 0
        left = round(goal - passes * size[source]) if passes < 2 else 0
        assert left <= mixing.FINE and taken[source] == passes * size[source] + best_sum([n for s, n in rows.values() if s == source], left)
        assert {copies[k] for k, (s, n) in rows.items() if s == source and n} <= {passes, passes + 1}
    assert {r["doc_id"]: r["text"] for r in mixed.select("doc_id", "text").distinct().collect()} == {k: after[k] for k in copies}

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(whole.encode(r["text"] or "", add_special_tokens=False).ids)) for r in mixed.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.select("doc_id", "ids").collect()) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in tokens.select("n_tokens", "ids").collect())
