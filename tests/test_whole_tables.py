import math
import re

import pytest

from colloquy import queries as Q

from .oracle import SF_DIR


def test_search_reads_all_documents_and_whole_queries(spark, tmp_path):
    texts = {1: ("alpha beta gamma", "en"), 2: ("omega alpha omega", "de"), 3: ("beta", None), 4: (None, "en"), 5: ("omega delta", "fr")}
    items = {1: "one two three four five six seven eight omega", 2: "alpha Omega alpha", 3: None}
    spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {k: re.findall("[a-z0-9]+", t) for k, (t, _) in texts.items() if t is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}

    def impact(word, doc):
        tf = doc.count(word)
        return round(1e6 * math.log(1 + (len(docs) - df[word] + 0.5) / (df[word] + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(doc) / mean)))

    want = {(q, k): sum(impact(w, d) for w in set(re.findall("[a-z0-9]+", text.lower())) if w in d) for q, text in items.items() if text for k, d in docs.items()}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in Q.QUERIES["search_topk"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v} and (1, 2) in got and (1, 5) in got
    stats = {r["term"]: (r["df"], r["tf"]) for r in Q.QUERIES["corpus_stats"](spark, str(tmp_path)).collect()}
    assert stats == {w: (n, sum(d.count(w) for d in docs.values())) for w, n in df.items()}


def test_all_customers_parts_and_ids_are_evaluated(spark):
    t = {n: Q.table(spark, SF_DIR, n).toPandas() for n in ("orders", "lineitem", "customer")}
    lines = t["orders"].merge(t["lineitem"], left_on="o_orderkey", right_on="l_orderkey")
    owned = set(zip(lines["o_custkey"], lines["l_partkey"]))
    run = lambda name: Q.QUERIES[name](spark, SF_DIR).collect()
    for name in ("evaluate_constraints", "page_readiness", "feedback_reasons", "extract_result"):
        rows = run(name)
        assert {(r["request_id"], r["part"]) for r in rows} == owned and len(rows) == len(owned)
    assert {(r["request_id"], int(r["asin"])) for r in run("merge_candidates")} == owned
    assert sum(r["checks"] for r in run("constraint_rates")) >= len(owned)
    every = set(t["customer"]["c_custkey"])
    assert {r["request_id"] for r in run("rule_rerank")} == {r["request_id"] for r in run("refresh_constraints")} == every
    assert {r["instance_id"]: r["n"] for r in run("select_instances")} == t["orders"]["o_custkey"].value_counts().to_dict()
    want = {f"{o}/{p}": str(p) if o % 3 == 0 else None for o, p in zip(t["lineitem"]["l_orderkey"], t["lineitem"]["l_partkey"])}
    assert {r["selection_id"]: r["asin"] for r in run("item_context")} == want


@pytest.mark.parametrize("name", ["stream_intentions", "stream_stop_monitor"])
def test_streams_leave_the_spread_to_spark(spark, monkeypatch, name):
    plans = []

    def seen(session, source, job, mode="append"):
        plans.append(source._jdf.queryExecution().logical().toString())
        raise LookupError

    monkeypatch.setattr(Q, "drained", seen)
    with pytest.raises(LookupError):
        Q.QUERIES[name](spark, SF_DIR)
    assert plans and not any("Repartition" in line for line in plans[0].splitlines())
