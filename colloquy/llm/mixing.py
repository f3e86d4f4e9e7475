"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets whole passes over its documents while its target allows. What is left of
the target is fitted by document length: documents are counted by exact length, each length
gives the same share of its documents, rounded down, of all but a reserve of the budget, then
larger lengths fill what is left until FINE words at most, and bounded-knapsack dynamic
programming closes the rest with the documents not yet taken. A budget of up to FINE words that
this doesn't meet is fitted again from nothing, so there no choice of documents comes nearer.
Which documents of a length are taken is a seeded choice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, pick, plain, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_PASSES = 2.0
SEED = 20240607
#: The dynamic programme works on budgets up to this many words, or the longest document.
FINE = 1 << 15
#: Documents of one length and source are chosen in buckets of about this many.
BUCKET_ROWS = 4096


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> dict:
    """Words for each source: by weight, at most `most` times its size, the excess shared again by weight."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    budget, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = max(budget, 0.0) / sum(weight[k] for k in open_)
        full = [k for k in open_ if weight[k] * unit > most * sizes[k]]
        if not full:
            return out | {k: weight[k] * unit for k in open_}
        for k in full:
            out[k] = most * sizes[k]
            budget -= out[k]
        open_ = [k for k in open_ if k not in full]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length sum up to the largest total that does not exceed budget: bounded-knapsack dynamic programming."""
    take = np.zeros(len(lengths), np.int64)
    # via[s] is the length with which the sum s was first reached.
    reached, via = np.zeros(budget + 1, bool), np.full(budget + 1, -1)
    reached[0] = True
    for i in np.argsort(-lengths, kind="stable"):
        size, left = int(lengths[i]), int(counts[i])
        if not size or size > budget or not left:
            continue
        new = reached
        for _ in range(min(left, budget // size)):
            step = np.zeros_like(reached)
            step[size:] = new[:-size]
            step &= ~reached
            if not step.any():
                break
            reached, new = reached | step, step
            via[step] = i
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        take[via[at]] += 1
        at -= int(lengths[via[at]])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, fine: int = FINE) -> np.ndarray:
    """How many documents of each length to take for at most `budget` words.

    Up to `fine` words, or the longest document if that is longer, no choice comes nearer. Beyond
    that the programme has that many words to play with, which in practice closes all but gaps
    that the lengths themselves forbid.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    fine = max(fine, int(lengths.max(initial=0)))
    share = max(0, budget - fine // 2) / total
    take = (counts * share).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and rest > fine:
            more = min(int(counts[i] - take[i]), (rest - fine) // int(lengths[i]) + 1, rest // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    take += knapsack(lengths, counts - take, rest)
    if budget <= fine and int((lengths * take).sum()) < budget:
        take = knapsack(lengths, counts, budget)
    take[lengths == 0] = counts[lengths == 0]
    return take


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", ignore_index=True)
    sizes, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    total, target = int((sizes * counts).sum()), float(frame["target"].iloc[0])
    passes = int(target // total) if total else 0
    frame["passes"] = passes
    frame["picks"] = fit(sizes, counts, round(target - passes * total)) if passes < MOST_PASSES else counts * 0
    return frame


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes it) and the given
    columns for each document. A budget's words are counted over whole texts, however long.

    A null text has size 0; null sources are one source, the last in order. Rows alike share
    a rank in any order, which changes no result. A source without words has target 0. An
    empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [f"own column {i}" for i in range(len(columns))]
    rows = stored(pick(docs, "doc_id", "text", "source", *columns).toDF("doc_id", "text", "source", *own).select("doc_id", "source", *own, size.alias("size"), F.xxhash64("text").alias("tie")))
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = {r["source"]: r["s"] for r in lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).collect()}
    goal = spark.createDataFrame([(k, sizes[k], float(v)) for k, v in targets(sizes, weights, share).items()], "own string, source_size long, target double")
    aimed = lengths.join(goal, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    plan = aimed.groupBy("source").applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, passes long, picks long")
    plan = stored(plan.toDF("p_source", "p_size", "n", "source_size", "target", "passes", "picks"))
    # Which documents of a length: in the order of a seeded hash, cut into buckets so that no length is one task. A row without
    # an id has its text's hash instead; xxhash64 passes over nulls.
    order = F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("tie")))
    keyed = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    keyed = keyed.withColumn("order", order).withColumn("bucket", F.floor((F.shiftrightunsigned("order", 32) * F.ceil(F.col("n") / BUCKET_ROWS)) / F.lit(float(1 << 32))))
    keyed = stored(keyed)
    before = keyed.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"), F.first("picks").alias("p"))
    before = before.withColumn("before", F.sum("in_bucket").over(W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), (F.col("p") - F.coalesce("before", F.lit(0))).alias("picks_here"))
    keyed = keyed.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
    rank = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("order", "doc_id", "tie"))
    copies = F.col("passes") + (rank <= F.col("picks_here")).cast("long")
    return keyed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(F.col(a).alias(b) for a, b in zip(own, columns)))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns, whatever those are called.

    A row without words, a null text too, comes as often as its source is passed, and once more where what
    is left of the target is fitted; of rows alike in doc_id, text and source one stands for all, as often as they are taken
    together. An empty table gives no row.
    """
    own = plain(docs, "doc_id", "text", "source")
    keyed = own.withColumn("text key", F.md5(F.col("text").cast("binary")))
    taken = mix_sources(keyed, weights, share, seed, ("text key",)).groupBy("doc_id", "text key", "source").agg(F.sum("copies").alias("copies")).where("copies > 0")
    taken = taken.toDF("own id", "own key", "own source", "copies taken")
    same = F.col("doc_id").eqNullSafe(F.col("own id")) & F.col("text key").eqNullSafe(F.col("own key")) & F.col("source").eqNullSafe(F.col("own source"))
    nth = F.row_number().over(W.partitionBy("doc_id", "text key", "source").orderBy("doc_id"))
    found = keyed.join(taken, same).withColumn("nth row", nth).where(F.col("nth row") == 1)
    return found.select(*own.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies taken").cast("int"))).alias("again")).select(*own.columns).toDF(*docs.columns)
