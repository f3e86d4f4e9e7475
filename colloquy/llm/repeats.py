"""Windows of consecutive units (words or bytes) whose content starts anywhere else.

A count-min sketch bounds how often each window occurs from above, by the least count of the
window's anchors. Anchors are grams of `gram` units that are least, by hash, among `spread`
neighbours; which grams are anchors of a window depends on that window alone, so equal
windows have equal anchors, and the sketch never counts less than there is. Only windows
whose bound is two or more go on: no repeated window is lost.

The windows left are grouped exactly. Each goes with the least gram in it: neighbours with
the same least gram travel as one context to the task of that gram, where all windows of the
group are compared. Grams that the sketch puts at 256 and more would make a group too
large for one task; windows of these are dealt out by their own names, packed, and what a
task holds twice already goes out once. Of texts that are alike, a task sends two at most,
which is enough to show that all their windows repeat.

A sketch of up to 2 ** sketch.MOST_BITS cells a row is sent to the executors. Beyond that it
stays a table: chunks of texts ask for the cells of their anchors and get their levels back.

Texts of more than STEP_BYTES are cut into pieces that overlap by a window less one unit, so
each window is in one piece, and memory doesn't follow the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .shared import STEP_BYTES, bound_batches, in_chunks, n_partitions, steps, stored, utf8

HOT = 3
#: Payload bytes of whole groups that are compared together.
TOGETHER = 1 << 20
#: Windows of large groups that a task looks at together, and bytes of them that another task gets, about.
BLOCK_WINDOWS, BUCKET_BYTES = 1 << 17, 4 << 20
#: Bytes of texts in a chunk that asks a sketch that stays a table.
CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class Kind:
    """What a window is made of."""

    size: int
    gram: int
    spread: int
    bytes_per_unit: float
    #: f(data, starts, ends) -> (f(lane number, units) -> hashes of windows, first unit of each row, end unit of each row, all units)
    units: object
    #: f(data, most) -> [(unit, from byte, to byte)], pieces of a long text of about `most` bytes
    pieces: object
    #: f(slice, first window and number of windows of each context) -> payload of each context as a binary array
    payload: object
    #: f(payloads as one binary array, numbers of windows) -> which windows are repeated in whole groups
    repeated: object

    @property
    def reach(self) -> int:
        """Places in a window at which `spread` grams begin."""
        return self.size - self.gram - self.spread + 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of x[i : i + n] for each i."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if span < n else x


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Neighbouring stretches of data, of these lengths, as one binary array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and each value's length."""
    data, starts, ends = utf8(column)
    return data, ends - starts


def stretches(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 and so on, lengths[0] of them, then those of begin[1] .."""
    return np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)


class Slice:
    """The units of some rows or pieces, their grams, and the least gram of each `spread` neighbours."""

    def __init__(self, kind: Kind, data, starts, ends):
        self.kind, self.data = kind, data
        self.hashes, self.first, self.last, n = kind.units(data, starts, ends)
        self.n = n
        place_bits = max(24, int(n).bit_length())
        self.grams = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        g = self.hashes(0, kind.gram)
        self.grams[: len(g)] = g
        self.place = np.uint64((1 << place_bits) - 1)
        self.ranked = (self.grams & ~self.place) | np.arange(n, dtype=np.uint64)
        # left[i]: units from i to the end of its row
        self.left = np.repeat(self.last, self.last - self.first) - np.arange(n) if n else np.zeros(0, np.int64)
        low = sliding_min(self.ranked, kind.spread)[: max(0, n - kind.spread + 1)] if n >= kind.spread else np.zeros(0, np.uint64)
        self.anchor = (low & self.place).astype(np.int64)
        whole = self.left[: len(low)] >= kind.spread + kind.gram - 1
        self.use = whole & np.repeat(self.last - self.first >= kind.size, self.last - self.first)[: len(low)]
        self.anchors = np.zeros(n, bool)
        self.anchors[self.anchor[self.use]] = True

    def keys(self) -> np.ndarray:
        """The grams of all anchors, one for each place."""
        return self.grams[self.anchors]

    def windows(self, levels) -> np.ndarray:
        """Windows all of whose anchors may be repeated, as their first units."""
        k = self.kind
        if self.n < k.size:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.anchors)
        maybe = np.zeros(self.n, bool)
        maybe[at[levels.of(self.grams[at]) > 0]] = True
        bad = np.ones(self.n, np.int32)
        bad[: len(self.use)] = ~(self.use & maybe[self.anchor])
        sums = np.r_[0, np.cumsum(bad)]
        fits = self.n - k.size + 1
        return np.flatnonzero((sums[k.reach : k.reach + fits] == sums[:fits]) & (self.left[:fits] >= k.size))

    def contexts(self, levels):
        """(first window, number of windows, gram, whether it is hot) of each context."""
        k, window = self.kind, self.windows(levels)
        if not len(window):
            return window, window, self.grams[:0], np.zeros(0, bool)
        low = sliding_min(self.ranked, k.size - k.gram + 1)
        at = (low[window] & self.place).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, (window[1:] != window[:-1] + 1) | (at[1:] != at[:-1]), True])
        grams = self.grams[at[edge[:-1]]]
        return window[edge[:-1]], np.diff(edge), grams, levels.of(grams) == HOT

    def names(self) -> np.ndarray:
        """Two 64-bit names of the window at each place."""
        return np.stack([self.hashes(lane, self.kind.size) for lane in (0, 1)], axis=1)


_CONTEXT = pa.schema([("hot", pa.bool_()), ("g", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
_CONTEXT_DDL = "hot boolean, g long, key binary, start long, n int, payload binary"


def _two_of_each(batches):
    """Batches without the rows of texts that the task has seen twice already."""
    sent: dict = {}
    for batch in batches:
        take = []
        for i, key in enumerate(batch.column("key").to_pylist()):
            seen = sent.get(key, 0)
            if seen < 2 and key is not None:
                sent[key] = seen + 1
                take.append(i)
        yield batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int64()))


def _slices(kind: Kind, batches):
    """Slices of the rows, the row of each of a slice's pieces in its batch, the unit in the row where a piece begins, and the batch."""
    for batch in batches:
        data, starts, ends = utf8(batch.column("text"))
        for i, j in steps(starts, ends):
            low = starts[i]
            if j == i + 1 and ends[i] - low > STEP_BYTES:
                whole = data[low : ends[i]]
                for unit, a, b in kind.pieces(whole, STEP_BYTES):
                    yield Slice(kind, whole[a:b], np.array([0]), np.array([b - a])), np.array([i]), np.array([unit]), batch
            else:
                yield Slice(kind, data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low), np.arange(i, j), np.zeros(j - i, np.int64), batch


def _anchor_keys(kind: Kind):
    def keys_of(batches):
        for part, *_ in _slices(kind, _two_of_each(batches)):
            yield part.keys()

    return keys_of


def _named(part: Slice, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The names of n windows from each first window on."""
    return binary_array(part.names()[stretches(first, n)], 16 * n)


def _sent(kind: Kind, batches, levels):
    """Contexts of the rows of batches, hot ones apart."""
    for part, rows, units, batch in _slices(kind, batches):
        first, n, grams, hot = part.contexts(levels)
        row = np.searchsorted(part.first, first, "right") - 1
        start = first - part.first[row] + units[row]
        keys = batch.column("key").take(pa.array(rows[row]))
        for which, payload in ((~hot, kind.payload), (hot, _named)):
            at = np.flatnonzero(which)
            if len(at):
                columns = [pa.array(hot[at]), pa.array(grams[at].astype(np.int64)), keys.take(pa.array(at)), pa.array(start[at]), pa.array(n[at].astype(np.int32)), payload(part, first[at], n[at])]
                yield pa.RecordBatch.from_arrays(columns, schema=_CONTEXT)


def _contexts(kind: Kind, sent):
    def scan(batches):
        yield from _sent(kind, _two_of_each(batches), sketch.Levels(sent))

    return scan


def _by_chunk(batches):
    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
        for i, j in zip(edge[:-1], edge[1:]) if len(chunk) else ():
            yield int(chunk[i]), batch.slice(i, j - i)


def _asking(kind: Kind, bits: int):
    def scan(batches):
        for chunk, rows in _by_chunk(batches):
            for part, *_ in _slices(kind, [rows]):
                yield sketch.asked(chunk, part.keys(), bits)

    return scan


def _answered(kind: Kind, bits: int):
    def scan(chunk: pa.Table, got: pa.Table) -> pa.Table:
        if not chunk.num_rows or not got.num_rows:
            return _CONTEXT.empty_table()
        levels = sketch.Answers(np.asarray(got.column("cell")), np.asarray(got.column("level")), bits)
        return pa.Table.from_batches(list(_sent(kind, chunk.combine_chunks().to_batches(), levels)), _CONTEXT)

    return scan


def contexts_of(texts: DataFrame, kind: Kind, most: int | None = None) -> DataFrame:
    """Contexts of all windows of texts (key, text) that may be repeated, stored."""
    most = sketch.MOST_BITS if most is None else most
    expected = int(sketch.total_bytes(texts) / kind.bytes_per_unit * 2 / (kind.spread + 1))
    if expected <= 1 << most:
        sent = sketch.build(texts, _anchor_keys(kind), expected, most=most)
        out = stored(texts.mapInArrow(_contexts(kind, sent), _CONTEXT_DDL), "hot")
        sent.destroy()
        return out
    bits = expected.bit_length() + 1
    chunks = in_chunks(texts.mapInArrow(_two_of_each, texts.schema), "text", CHUNK_BYTES)
    got = sketch.answers(stored(chunks.mapInArrow(_asking(kind, bits), "chunk long, cell long, n long")))
    return stored(chunks.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(_answered(kind, bits), _CONTEXT_DDL), "hot")


def equal_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two names occur twice or more, and one row of each name."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    same = (names[order][1:] == names[order][:-1]).all(axis=1)
    out = np.zeros(len(names), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out, order[np.r_[True, ~same][: len(order)]]


def _runs_of(repeated: np.ndarray, counts: np.ndarray):
    """The maximal runs (context, from, to) of contexts' repeated windows."""
    row = np.repeat(np.arange(len(counts)), counts)
    offset = stretches(np.zeros(len(counts), np.int64), counts)
    begin = repeated & np.r_[True, ~repeated[:-1] | (row[1:] != row[:-1])][: len(row)]
    end = repeated & np.r_[~repeated[1:] | (row[1:] != row[:-1]), True][: len(row)]
    return row[begin], offset[begin], offset[end]


_SPAN = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])


def _compare(kind: Kind):
    """Repeated windows of whole groups; rows come sorted by g."""

    def flush(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        counts = np.asarray(rows.column("n")).astype(np.int64)
        row, low, high = _runs_of(kind.repeated(rows.column("payload"), counts), counts)
        start = np.asarray(rows.column("start"))[row]
        return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks().take(pa.array(row)), pa.array(start + low), pa.array(start + high)], schema=_SPAN)

    def scan(batches):
        held, size, last = [], 0, None
        for batch in batches:
            g = np.asarray(batch.column("g"))
            if not len(g):
                continue
            lengths = binary_bytes(batch.column("payload"))[1]
            sizes, begin = np.cumsum(lengths), 0
            # places where a group begins; rows up to there are whole groups
            for i in np.flatnonzero(np.r_[last is not None and g[0] != last, g[1:] != g[:-1]]):
                here = int(sizes[i - 1] if i else 0) - int(sizes[begin - 1] if begin else 0)
                if size + here >= TOGETHER:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield flush(held)
                    held, size, begin = [], 0, int(i)
            held.append(batch.slice(begin))
            size, last = size + int(sizes[-1]) - int(sizes[begin - 1] if begin else 0), g[-1]
        if held:
            yield flush(held)

    return scan


_ENTRY = np.dtype([("one", "<u8"), ("two", "<u8"), ("key", "<u8", 2), ("low", "<i8")])
_PACKED = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("key", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
_PACKED_DDL = "bucket int, entries binary, key binary, low long, high long"


def _pack(buckets: int):
    """Windows of large groups, by bucket of their names.

    A window that a block of rows holds twice is repeated for certain: its places go out as spans
    (bucket -1), and one entry without a place tells other blocks. All others go out as entries.
    """

    def flush(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        counts = np.asarray(rows.column("n")).astype(np.int64)
        names = binary_bytes(rows.column("payload"))[0].view(np.uint64).reshape(-1, 2)
        keys = binary_bytes(rows.column("key"))[0].view(np.uint64).reshape(-1, 2)
        starts = np.asarray(rows.column("start"))
        row, low = np.repeat(np.arange(len(counts)), counts), stretches(starts, counts)
        repeated, first = equal_names(names)
        at, begin, end = _runs_of(repeated, counts)
        known = [pa.array(np.full(len(at), -1, np.int32)), pa.nulls(len(at), pa.binary()), rows.column("key").combine_chunks().take(pa.array(at)), pa.array(starts[at] + begin), pa.array(starts[at] + end)]
        yield pa.RecordBatch.from_arrays(known, schema=_PACKED)
        sent = np.zeros(len(first), _ENTRY)
        sent["one"], sent["two"] = names[first, 0], names[first, 1]
        sent["key"], sent["low"] = keys[row[first]], np.where(repeated[first], -1, low[first])
        bucket = (sent["one"] % np.uint64(buckets)).astype(np.int32)
        sent, bucket = sent[np.argsort(bucket, kind="stable")], np.sort(bucket)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        n = len(edge) - 1
        parts = binary_array(sent.view(np.uint8), np.diff(edge) * _ENTRY.itemsize)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), parts, *(pa.nulls(n, t) for t in (pa.binary(), pa.int64(), pa.int64()))], schema=_PACKED)

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += int(np.asarray(batch.column("n")).sum())
            if n >= BLOCK_WINDOWS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return scan


def _unpack(batches):
    """Windows of whole buckets that have two entries, or one from a block that has it twice."""
    parts = [raw for batch in batches for raw in batch.column("entries").to_pylist()]
    entries = np.frombuffer(b"".join(parts), _ENTRY)
    if not len(entries):
        return
    entries = entries[np.lexsort((entries["two"], entries["one"]))]
    new = np.r_[True, (entries["one"][1:] != entries["one"][:-1]) | (entries["two"][1:] != entries["two"][:-1])]
    group = np.cumsum(new) - 1
    known = (np.bincount(group) > 1) | (np.bincount(group, entries["low"] < 0) > 0)
    found = entries[known[group] & (entries["low"] >= 0)]
    keys = binary_array(np.ascontiguousarray(found["key"]), np.full(len(found), 16))
    yield pa.RecordBatch.from_arrays([keys, pa.array(found["low"].astype(np.int64))], names=["key", "low"])


def repeated_spans(texts: DataFrame, kind: Kind, most: int | None = None) -> DataFrame:
    """(key, spans): for each text that has any, its repeated windows, as runs and as words of 64 bits.

    A span is (low, high, bits): the windows low .. high if bits is null, else the windows low + k for all k set in
    bits. Single windows meet in such words before a text's spans do, so a text that is repeated all through
    makes a row of a few bytes for 64 windows at most.
    """
    spark = texts.sparkSession
    contexts = contexts_of(texts, kind, most)
    grouped = contexts.where("not hot").drop("hot").repartition("g").sortWithinPartitions("g").mapInArrow(_compare(kind), "key binary, low long, high long")
    hot = contexts.where("hot").select("key", "start", "n", "payload")
    windows = hot.agg(F.sum("n")).first()[0] or 0
    buckets = n_partitions(spark, windows * _ENTRY.itemsize, BUCKET_BYTES)
    packed = stored(hot.mapInArrow(_pack(buckets), _PACKED_DDL))
    alone = packed.where("bucket >= 0").select("bucket", "entries").repartition(buckets, "bucket").mapInArrow(_unpack, "key binary, low long")
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("low").bitwiseAND(63).cast("int")))
    words = alone.groupBy("key", F.shiftright("low", 6).alias("word")).agg(bit.alias("bits")).select("key", F.shiftleft("word", 6).alias("low"), F.lit(None).cast("long").alias("high"), "bits")
    runs = grouped.union(packed.where("bucket < 0").select("key", "low", "high")).withColumn("bits", F.lit(None).cast("long"))
    return runs.union(words).groupBy("key").agg(F.collect_set(F.struct("low", "high", "bits")).alias("spans"))


def with_spans(docs: DataFrame, kind: Kind, most: int | None = None) -> DataFrame:
    """docs (text and others) with the column spans; null where no window is repeated. No column may be called `text key`.

    Windows are found by distinct texts, named by their MD5.
    """
    bound_batches(docs.sparkSession)
    keyed = docs.withColumn("text key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = keyed.where(F.col("text").isNotNull()).select(F.col("text key").alias("key"), "text")
    spans = stored(repeated_spans(texts, kind, most)).withColumnRenamed("key", "text key")
    return keyed.join(spans, "text key", "left").drop("text key")


def removed(spans: list | None, n: int, size: int) -> np.ndarray:
    """Which of n units the windows in spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        if s["bits"] is None:
            edge[s["low"]] += 1
            edge[min(n, s["high"] + size)] -= 1
        else:
            at = s["low"] + np.flatnonzero(np.unpackbits(np.array([s["bits"]], "<i8").view(np.uint8), bitorder="little"))
            edge[at] += 1
            np.subtract.at(edge, np.minimum(n, at + size), 1)
    return np.cumsum(edge[:-1]) > 0
