"""Helpers that the operators share: the shared folder, Arrow columns as bytes, hashes."""

from __future__ import annotations

import hashlib
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: A word is a maximal run of characters other than these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; memory per task is a multiple of about a hundred.
STEP_BYTES = 1 << 19
#: Longer strings are hashed by BLAKE2.
LONG_BYTES = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Rows of an Arrow batch. Spark's 10,000 would be tens of MB of long texts, in the JVM and in Python.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/colloquy/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_colloquy_worker_cache", types.ModuleType("cache")).__dict__


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; extra columns, also with names that differ in case only, stay out."""
    bound_batches(df.sparkSession)
    exact = {n: [i for i, c in enumerate(df.columns) if c == n] for n in names}
    if any(len(v) != 1 for v in exact.values()):
        return df.select(*names)
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{exact[n][0]}").alias(n) for n in names])


def plain(df: DataFrame, *names: str) -> DataFrame:
    """All columns of df: the named ones keep their names, others get names that clash with nothing.

    The columns stay in place, so toDF(*df.columns) undoes it.
    """
    bound_batches(df.sparkSession)
    return df.toDF(*[c if c in names else f"other column {i}" for i, c in enumerate(df.columns)])


def _dealt(column: str, most: int, names: list[str], schema: pa.Schema):
    def deal(batches):
        chunk, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            _, starts, ends = utf8(batch.column(column))
            numbers = []
            for n in (ends - starts).tolist():
                if held and held + n > most:
                    chunk, held = chunk + 1, 0
                held += n
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(numbers, pa.int64())], schema=schema)

    return deal


def in_chunks(df: DataFrame, column: str, most: int) -> DataFrame:
    """df with the column chunk, which numbers runs of rows of about `most` bytes, one row at least; stored, so that chunks stay as they are."""
    names, out = df.columns, df.withColumn("chunk", F.lit(0).cast("long"))
    return stored(df.mapInArrow(_dealt(column, most, names, to_arrow_schema(out.schema)), out.schema))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string or binary column with each row's start and end; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    starts, ends = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return data, starts, ends


def steps(starts: np.ndarray, ends: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes, one row at least."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Lane:
    """One 64-bit hash function of byte strings and of windows of values, fixed by its number.

    Neighbours are joined by a step that isn't linear, so no text adds up to the hash of another by its make-up
    (as words of Thue and Morse do under any polynomial modulo 2 ** 64).
    """

    def __init__(self, number: int):
        rng = np.random.default_rng(7919 + number)
        self.number = number
        self.left = np.uint64(int(rng.integers(1 << 60, 1 << 62)) * 4 + 1)
        self.right = np.uint64(int(rng.integers(1 << 60, 1 << 62)) * 4 + 3)

    def both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of a followed by b."""
        x = a * self.left
        x += b * self.right
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x

    def segments(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hash of each byte segment: eight bytes at a time, segments of over LONG_BYTES by BLAKE2."""
        out = mix(lengths.astype(np.uint64) * self.right)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        at = np.arange(len(starts))
        for k in range(0, LONG_BYTES, 8):
            left = lengths[at] - k
            out[at] = self.both(out[at], eight[starts[at] + k] & _FIRST_BYTES[np.minimum(left, 8)])
            at = at[left > 8]
            if not len(at):
                break
        for i in at.tolist():
            raw = data[starts[i] : starts[i] + lengths[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([self.number])).digest(), "little")
        return mix(out)

    def windows(self, values: np.ndarray, size: int, span: int = 1) -> np.ndarray:
        """Hash of the `size` units from each place on.

        values[i] tells what the `span` units from i on are, in 64 bits. Stretches are doubled while they fit; two
        that overlap, one from the start and one up to the end, make the window.
        """
        n = len(values) - (size - span)
        if n <= 0:
            return np.zeros(0, np.uint64)
        while 2 * span <= size:
            values = self.both(values[:-span], values[span:])
            span *= 2
        return mix(self.both(values[:n], values[size - span :]) if span < size else values[:n])

    def byte_windows(self, data: np.ndarray, size: int) -> np.ndarray:
        """Hash of data[i : i + size] for each i."""
        span = min(8, 1 << (size.bit_length() - 1))
        if len(data) < size:
            return np.zeros(0, np.uint64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) - span + 1, "<u8", padded, strides=(1,))
        return self.windows(eight & _FIRST_BYTES[span], size, span)


def lanes() -> tuple[Lane, Lane]:
    """The two hash functions that together name a string by 128 bits."""
    cache = worker_cache()
    if "lanes" not in cache:
        cache["lanes"] = (Lane(0), Lane(1))
    return cache["lanes"]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in UTF-8 bytes; the white space of WORD is ASCII, so bytes suffice."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lower_words(data, starts, ends):
    """The bytes with A-Z in lower case and a space after each row; words of digits, letters and characters beyond ASCII as spans of it; their rows."""
    shift = np.arange(len(starts), dtype=np.int64)
    spaced = np.full(len(data) + len(starts), 0x20, np.uint8)
    keep = np.ones(len(spaced), bool)
    keep[ends + shift] = False
    spaced[keep] = data
    spaced += ((spaced >= 65) & (spaced <= 90)).view(np.uint8) << 5
    inside = np.zeros(len(spaced) + 1, bool)
    inside[1:] = _LETTERS[spaced]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    return spaced, begin, end, np.searchsorted(starts + shift, begin, "right") - 1


def n_partitions(spark: SparkSession, rows_or_bytes: int, each: int) -> int:
    """Shuffle partitions that hold about `each` apiece, never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows_or_bytes) // each))
