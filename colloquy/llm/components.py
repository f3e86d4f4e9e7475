"""Connected components of a graph of edges, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

MOST_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); the root is a component's least node.

    Each round gives a node the least label of itself and its neighbours, then that label's
    own label. Only least values are gathered, so no node's neighbours meet in one row.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    for _ in range(MOST_ROUNDS):
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        near = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "theirs").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stored(near.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("above", "root")).alias("root")))
        changed = new.where("was <> root").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
    raise RuntimeError("the components didn't settle")
