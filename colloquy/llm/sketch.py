"""Count-min sketches that are built in partitions and merged by Spark.

Cells never count less than their keys occurred, so what they report as rare is rare. A cell
is kept as one of four levels: under 2, under 16, under 256, and more. A sketch of bounded size
is sent to every executor; a larger one stays a table of cells, and who asks joins it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, n_partitions

LEVELS = (2, 16, 256)
BLOCK_BITS = 16
#: Cells of a row: about one a key, at most 2 ** MOST_BITS where it is sent. Two rows of that are
#: 64 MB on the driver and in each Python worker.
LEAST_BITS, MOST_BITS = 16, 27
#: Keys that a task counts before it sends them on.
FLUSH = 1 << 20


def row_bits(keys: int, most: int = MOST_BITS) -> int:
    return min(most, max(LEAST_BITS, int(keys).bit_length()))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64)


_PART = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def _parts(keys: list[np.ndarray], depth: int, bits: int):
    """One row for each touched block of 2 ** BLOCK_BITS cells: its cells, and their counts less one, cut at the last level."""
    all_keys = np.concatenate(keys)
    for row in range(depth):
        cell, n = np.unique(cells(all_keys, row, bits), return_counts=True)
        block = cell >> BLOCK_BITS
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        low, n = (cell & ((1 << BLOCK_BITS) - 1)).astype("<u2"), (np.minimum(n, LEVELS[-1]) - 1).astype(np.uint8)
        base = row << (bits - BLOCK_BITS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((base + block[edge[:-1]]).astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
            ],
            schema=_PART,
        )


def _merge(batches):
    sums: dict = {}
    for batch in batches:
        for block, low, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
            own = sums.get(block)
            if own is None:
                own = sums[block] = np.zeros(1 << BLOCK_BITS, np.uint32)
            own[np.frombuffer(low, "<u2")] += np.frombuffer(n, np.uint8).astype(np.uint32) + 1
    for block, own in sums.items():
        level = np.searchsorted(LEVELS, own, "right").astype(np.uint8).reshape(-1, 4)
        packed = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["block", "levels"])


def build(texts: DataFrame, keys_of, expected: int, depth: int = 2, most: int = MOST_BITS):
    """A broadcast (levels, depth, bits). keys_of(batches) yields arrays of 64-bit keys."""
    bits = row_bits(expected, most)

    def scan(batches):
        held, n = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield from _parts(held, depth, bits)
                held, n = [], 0
        if n:
            yield from _parts(held, depth, bits)

    spark = texts.sparkSession
    n = n_partitions(spark, depth << bits, 1 << 23)
    merged = texts.mapInArrow(scan, "block int, cells binary, counts binary").repartition(n, "block").mapInArrow(_merge, "block int, levels binary")
    table = np.zeros((depth << bits) // 4, np.uint8)
    size = (1 << BLOCK_BITS) // 4
    for r in merged.toLocalIterator():
        table[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    return spark.sparkContext.broadcast((table.tobytes(), depth, bits))


class Levels:
    """What a task reads from the broadcast."""

    def __init__(self, sent):
        raw, self.depth, self.bits = sent.value
        self.table = np.frombuffer(raw, np.uint8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: the least over all rows."""
        out = np.full(len(keys), 3, np.uint8)
        for row in range(self.depth):
            cell = cells(keys, row, self.bits) + (row << self.bits)
            np.minimum(out, (self.table[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8)) & 3, out=out)
        return out


def asked(chunk: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """The cells that a chunk touches in a sketch that stays a table, and how often."""
    cell, n = np.unique(cells(keys, 0, bits), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), chunk)), pa.array(cell), pa.array(n.astype(np.int64))], names=["chunk", "cell", "n"])


def answers(asking: DataFrame) -> DataFrame:
    """(chunk, cell, level) of those cells in `asking` (chunk, cell, n) whose level isn't 0; partial counts come first."""
    level = F.when(F.col("all") >= LEVELS[2], 3).when(F.col("all") >= LEVELS[1], 2).otherwise(1).cast("byte")
    merged = asking.groupBy("cell").agg(F.sum("n").alias("all")).where(F.col("all") >= LEVELS[0])
    return asking.join(merged, "cell").select("chunk", "cell", level.alias("level"))


class Answers:
    """What a chunk got back, in place of Levels."""

    def __init__(self, cell: np.ndarray, level: np.ndarray, bits: int):
        order = np.argsort(cell)
        self.cell, self.level, self.bits = cell[order], level[order].astype(np.uint8), bits

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.cell):
            return np.zeros(len(keys), np.uint8)
        cell = cells(keys, 0, self.bits)
        at = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
        return np.where(self.cell[at] == cell, self.level[at], 0).astype(np.uint8)


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
