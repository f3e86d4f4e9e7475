"""Suffix-array dedup of byte windows by bucket-pointer refinement.

Suffixes are sorted only as far as one window, and only where a repeated window is possible
(see repeats.py, which brings all windows with the same least gram together). In a group of
contexts the suffixes are first put into buckets by their q-grams, a quarter of half a window
or less deep. Then each bucket of two or more is refined by sorting its suffixes on the
identifier of the bucket, `depth` bytes later, that each points to; the new identifiers are
what the next refinement sorts on, so the depth doubles each time. Buckets of one are
never touched again. All identifiers of a round are of one depth, because windows must
be told apart by exactly `size` bytes and by nothing behind them. The last refinement sorts
window starts on two pointers that together span the window; neighbours alike are
equal windows. Contexts that are alike as a whole are refined once.

Windows of very frequent grams don't meet in one task; those are told apart by 128-bit names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import repeats
from .shared import lanes, pick, plain

WINDOW = 400
#: Refinements that double the depth, before the last one.
DOUBLINGS = 2


def numbered(keys: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of equal keys, numbered in sorted order from `first` on, and which keys share theirs."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]][: len(keys)]
    bucket, shared = np.empty(len(keys), np.uint64), np.empty(len(keys), bool)
    bucket[order] = (np.cumsum(new) + (first - 1)).astype(np.uint64)
    shared[order] = ~new | np.r_[~new[1:], False][: len(keys)]
    return bucket, shared


def refine(data: np.ndarray, left: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows that start at the places `window` are equal to another; left[i]: bytes from i to its context's end."""
    half = -(-size // 2)
    depth = max(1, size >> (DOUBLINGS + 1))
    digests = lanes()[0].byte_windows(data, depth)
    bucket = np.zeros(len(data), np.uint64)
    shared = np.zeros(len(data), bool)
    at = np.flatnonzero(left[: len(digests)] >= depth)
    bucket[at], shared[at] = numbered(digests[at], 1)
    last = len(at)
    while depth < half:
        step = min(depth, half - depth)
        at = np.flatnonzero(shared & (left >= depth + step))
        shared[:] = False
        bucket[at], shared[at] = numbered(bucket[at] << np.uint64(32) | bucket[at + step], last + 1)
        last, depth = last + len(at), depth + step
    out = np.zeros(len(window), bool)
    own = np.flatnonzero(shared[window])
    place = window[own]
    out[own] = numbered(bucket[place] << np.uint64(32) | bucket[place + size - depth], 1)[1]
    return out


def _units(data, starts, ends):
    return (lambda lane, size: lanes()[lane].byte_windows(data, size)), starts, ends, len(data)


def kind_of(size: int = WINDOW) -> repeats.Kind:
    """Windows of `size` bytes, 8 at least."""

    def pieces(data, most):
        return [(at, at, min(len(data), at + most + size - 1)) for at in range(0, len(data), most)]

    def payload(part, first, n):
        return repeats.binary_array(part.data[repeats.stretches(first, n + size - 1)], n + size - 1)

    def repeated(payloads, counts):
        data, lengths = repeats.binary_bytes(payloads)
        # contexts that are alike as a whole: all their windows are repeated, and one of them stands for all
        known: dict = {}
        of = np.array([known.setdefault(x, len(known)) for x in payloads.to_pylist()])
        times = np.bincount(of, minlength=len(known))
        one = np.unique(of, return_index=True)[1]
        begin = (np.cumsum(lengths) - lengths)[one]
        data = data[repeats.stretches(begin, lengths[one])]
        end = np.cumsum(lengths[one])
        left = np.repeat(end, lengths[one]) - np.arange(len(data))
        found = refine(data, left, repeats.stretches(end - lengths[one], counts[one]), size) | np.repeat(times > 1, counts[one])
        return found[repeats.stretches((np.cumsum(counts[one]) - counts[one])[of], counts)]

    gram = max(2, size // 10)
    return repeats.Kind(size, gram, max(2, min(64, size - gram)), 1.0, _units, pieces, payload, repeated)


def _spans(batch: pa.RecordBatch, size: int):
    """(text, its bytes, which of them repeated windows cover) of each row."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        for value, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
            raw = np.frombuffer((value or "").encode(), np.uint8)
            yield value, raw, repeats.removed(spans, len(raw), size)


def remove_repeated_bytes(docs: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document.

    A null or empty text has no bytes. Rows alike lose all that their windows cover. An empty
    table gives no row; other columns are not read. A very long text is scanned in pieces, and
    only the last step, which gives it back, holds it whole. `most` bounds the bits of the
    sketch that is sent to executors.
    """
    rows = repeats.with_spans(pick(docs, "doc_id", "text"), kind_of(size), most)
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def scan(batches):
        for batch in batches:
            out = []
            for _, raw, gone in _spans(batch, size):
                n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return rows.select("doc_id", "text", "spans").mapInArrow(scan, f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """docs with each text cut down to the bytes that no repeated window covers, without characters cut in part.

    All columns stay, whatever they are called; a column n_chars follows the text. A null text
    stays null; rows alike are cut alike; an empty table gives no row.
    """
    own = plain(docs, "text", "n_chars")
    rows = repeats.with_spans(own, kind_of(size), most)
    schema, names = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in own.schema]), own.columns

    def scan(batches):
        for batch in batches:
            out = [value if value is None or not gone.any() else raw[~gone].tobytes().decode("utf-8", "ignore") for value, raw, gone in _spans(batch, size)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], schema=schema)

    out = rows.mapInArrow(scan, own.schema)
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)
