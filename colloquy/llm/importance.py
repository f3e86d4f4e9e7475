"""Target-distribution importance resampling.

Documents are drawn so that their word n-grams follow a target text. N-grams fall into a fixed
number of buckets; a bucket's gain is the log ratio of its smoothed shares in the target and in
all documents, a document's weight the sum of the gains of its n-grams, and the highest weights
after seeded Gumbel noise are drawn, which is sampling without replacement in proportion to
the ratio of likelihoods.

In a batch n-grams are interned in an open-addressed table of numpy columns: XXH64 of an n-gram
gives the slot to begin at, and an n-gram shares a slot only if its bytes are equal, else it goes
on to the next. A slot holds bucket and count, so CRC-32 runs once for each distinct n-gram, counts
leave a batch by bucket, and the slot ids of occurrences gather the gains.

Ranks are global: rows are dealt out by ranges of score, numbered inside a range, and only the
sizes of ranges are added up on the driver.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .quality import _rows
from .repeats import stretches
from .shared import lower_words, n_partitions, pick, stored

NGRAM = 1
BUCKETS = 10000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: N-grams that are looked up together; the table keeps room for twice as many more.
BLOCK = 1 << 16
#: Bytes of a ranked row, and of a range of them, about.
_ROW_BYTES, _RANGE_BYTES = 32, 16 << 20

# The multipliers of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_U = np.uint64


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def xxh64(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each stretch of data; those under 32 bytes side by side."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = _P5 + lengths.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero(lengths >= 8 * k + 8)
        h[at] = _turned(h[at] ^ (_turned(eight[begin[at] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
    done = lengths & ~7
    at = np.flatnonzero(lengths & 4)
    h[at] = _turned(h[at] ^ ((eight[begin[at] + done[at]] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    done = lengths & ~3
    for k in range(3):
        at = np.flatnonzero((lengths & 3) > k)
        h[at] = _turned(h[at] ^ (data[begin[at] + done[at] + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> _U(33)
    h *= _P2
    h ^= h >> _U(29)
    h *= _P3
    h ^= h >> _U(32)
    for i in np.flatnonzero(lengths >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[begin[i] : begin[i] + lengths[i]])
    return h


class Interned:
    """An open-addressed table of byte strings: for each slot the hash, the bytes, the bucket, and how often it occurred."""

    def __init__(self, buckets: int, bits: int = 18):
        self.buckets, self.used, self.stored = buckets, 0, 0
        self.bytes = np.zeros(1 << 18, np.uint8)
        self._make(bits)

    def _make(self, bits: int) -> None:
        n = 1 << bits
        self.mask = n - 1
        self.key, self.begin, self.length = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.bucket, self.count = np.zeros(n, np.int32), np.zeros(n, np.int64)

    def _grow(self, more: int) -> None:
        if 2 * (self.used + more) <= self.mask + 1:
            return
        live = np.flatnonzero(self.length >= 0)
        old = [a[live] for a in (self.key, self.begin, self.length, self.bucket, self.count)]
        self._make(int(2 * (self.used + more)).bit_length())
        at, left = (old[0] & _U(self.mask)).astype(np.int64), np.arange(len(live))
        while len(left):
            free = left[self.length[at[left]] < 0]
            self.begin[at[free]] = free  # of several, the last stays
            won = free[self.begin[at[free]] == free]
            for own, was in zip((self.key, self.begin, self.length, self.bucket, self.count), old):
                own[at[won]] = was[won]
            placed = np.zeros(len(live), bool)
            placed[won] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & self.mask

    def _keep(self, data, begin, lengths) -> np.ndarray:
        """Places in the table's own bytes of copies of the stretches."""
        n = int(lengths.sum())
        while self.stored + n > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
        self.bytes[self.stored : self.stored + n] = data[stretches(begin, lengths)]
        out = self.stored + np.cumsum(lengths) - lengths
        self.stored += n
        return out

    def _same(self, slot, data, begin, lengths) -> np.ndarray:
        """Which stretches equal their slot's bytes."""
        out = self.length[slot] == lengths
        at = np.flatnonzero(out)
        n = lengths[at]
        unlike = data[stretches(begin[at], n)] != self.bytes[stretches(self.begin[slot[at]], n)]
        out[at] = np.add.reduceat(unlike, np.cumsum(n) - n, dtype=np.int64) == 0 if len(at) else True
        return out

    def slots(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of each stretch of data, none of them empty; new ones get a slot. Slots of earlier calls don't hold after another."""
        self._grow(len(begin))
        h = xxh64(data, begin, lengths)
        slot, left = (h & _U(self.mask)).astype(np.int64), np.arange(len(begin))
        owner = np.full(self.mask + 1, -1, np.int64)
        while len(left):
            free = left[self.length[slot[left]] < 0]
            owner[slot[free]] = free
            new = free[owner[slot[free]] == free]
            at = slot[new]
            self.key[at], self.begin[at], self.length[at] = h[new], self._keep(data, begin[new], lengths[new]), lengths[new]
            raw = self.bytes
            self.bucket[at] = [zlib.crc32(raw[a : a + n]) % self.buckets for a, n in zip(self.begin[at].tolist(), lengths[new].tolist())]
            self.used += len(new)
            like = left[self.key[slot[left]] == h[left]]
            found = np.zeros(len(begin), bool)
            found[like[self._same(slot[like], data, begin[like], lengths[like])]] = True
            left = left[~found[left]]
            slot[left] = (slot[left] + 1) & self.mask
        np.add.at(self.count, slot, 1)
        return slot


def _grams(batch, n: int):
    """(bytes, begin, length, row) of all runs of 1 to n words of a batch's texts, words joined by one space, in blocks; and the words of each row."""
    words = np.zeros(batch.num_rows, np.int64)

    def blocks():
        tail, of = [], -1
        for i, data, starts, ends in _rows(batch):
            spaced, begin, end, row = lower_words(data, starts, ends)
            words[i : i + len(starts)] += np.bincount(row, minlength=len(starts))
            size = end - begin
            # words of a row one space apart; those that a long text's piece before ended with come first
            held = tail if i == of else []
            joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
            place = np.cumsum(size + 1) - (size + 1)
            joined[stretches(place, size)] = spaced[stretches(begin, size)]
            if held:
                head = b" ".join(held) + b" "
                joined = np.concatenate([np.frombuffer(head, np.uint8), joined])
                before = np.array([len(x) for x in held])
                place = np.r_[np.cumsum(before + 1) - (before + 1), place + len(head)]
                size, row = np.r_[before, size], np.r_[np.zeros(len(held), np.int64), row]
            for k in range(1, n + 1):
                first = np.arange(max(0, len(held) - k + 1), len(size) - k + 1)
                first = first[row[first] == row[first + k - 1]]
                for a in range(0, len(first), BLOCK):
                    at = first[a : a + BLOCK]
                    yield joined, place[at], place[at + k - 1] + size[at + k - 1] - place[at], i + row[at]
            of, last = i + len(starts) - 1, row[-1] if len(row) else -1
            own = np.flatnonzero(row == last)[-(n - 1) :] if n > 1 and last == len(starts) - 1 else []
            tail = [joined[place[x] : place[x] + size[x]].tobytes() for x in own]

    return blocks(), words


def _counted(n: int, buckets: int):
    """How often each bucket occurs in a partition."""

    def scan(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            table = Interned(buckets)
            for data, begin, lengths, _ in _grams(batch, n)[0]:
                table.slots(data, begin, lengths)
            live = table.length >= 0
            np.add.at(total, table.bucket[live], table.count[live])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return scan


def bucket_counts(texts: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of n-grams of all texts by bucket; what reaches the driver is one number a bucket."""
    counted = pick(texts, "text").mapInArrow(_counted(n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of the smoothed share in the target over that in the source, rounded down."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, n: int = NGRAM) -> DataFrame:
    """docs (all its columns, text among them) without text, with n_features, n_words and weight."""
    kept = [c for c in docs.columns if c != "text"]
    out = docs.drop("text").selectExpr("*", "0L as n_features", "0L as n_words", "0L as weight")
    schema, sent = to_arrow_schema(out.schema), docs.sparkSession.sparkContext.broadcast(gains)

    def scan(batches):
        own = sent.value
        for batch in batches:
            table, features, weight = Interned(len(own)), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            blocks, words = _grams(batch, n)
            for data, begin, lengths, row in blocks:
                slot = table.slots(data, begin, lengths)
                np.add.at(features, row, 1)
                np.add.at(weight, row, own[table.bucket[slot]])
            columns = [batch.column(c) for c in kept] + [pa.array(x) for x in (features, words, weight)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(scan, out.schema)


def _nth(schema: pa.Schema):
    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n + 1, n + 1 + batch.num_rows))], schema=schema)
            n += batch.num_rows

    return number


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows, which must be stored, with rank: 1, 2, 3 .. in the order of the given columns.

    Equal rows are ranked in the order they are read in, so no range outgrows the others by ties.
    """
    spark = rows.sparkSession
    tied = rows.withColumn("read as", F.monotonically_increasing_id())
    order = [*order, F.col("read as")]
    n = n_partitions(spark, rows.count() * _ROW_BYTES, _RANGE_BYTES)
    dealt = tied.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("read as")
    numbered = dealt.withColumns({"part": F.lit(0), "nth": F.lit(0).cast("long")})
    numbered = stored(dealt.mapInArrow(_nth(to_arrow_schema(numbered.schema)), numbered.schema))
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part int, before long")
    return numbered.join(starts, "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "before", "nth")


def resample(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null where it isn't drawn.

    docs has doc_id and text, target text. Of the documents with min_words words or more,
    floor(percent of them) of the highest scores are drawn, ties to the smaller doc_id, a null one
    last; its noise is that of an empty id. A null or empty text has no words and weighs
    nothing. Rows alike score alike and are drawn each for itself. An empty table gives no
    row, an empty target gains of the smoothing alone; other columns are not read.
    """
    rows = pick(docs, "doc_id", "text")
    gains = gains_of(bucket_counts(rows, n, buckets), bucket_counts(target, n, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((noise + 0.5) / 4294967296.0))).cast("long")
    scored = stored(weighed(rows, gains, n).withColumn("score", F.col("weight") + gumbel))
    enough = F.col("n_words") >= min_words
    eligible = scored.where(enough)
    drawn = eligible.count() * percent // 100
    first = ranked(eligible, F.desc("score"), F.asc_nulls_last("doc_id"))
    names = ["doc_id", "n_features", "weight", "score"]
    own = first.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return own.union(scored.where(~enough).select(*names, F.lit(None).cast("long").alias("rank")))
