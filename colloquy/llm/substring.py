"""Substring dedup of word windows with a count-min prefilter.

Sketches of partitions are merged into one that overestimates how often each window occurs,
by the least count of the grams that anchor it; a second pass groups exactly the windows that
it takes for repeated, and loses none. See repeats.py.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import repeats
from .shared import lanes, pick, word_spans

WINDOW = 35


def _apart(data, starts, ends):
    """The bytes with a space after each row, so that no word spans two rows; and the rows' new starts."""
    shift = np.arange(len(starts), dtype=np.int64)
    out = np.full(len(data) + len(starts), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[ends + shift] = False
    out[keep] = data
    return out, starts + shift


def words_of(data, starts, ends):
    """Hashes of words by lane, each computed when it is asked for, and each row's first word and end."""
    spaced, begins = _apart(data, starts, ends)
    begin, end = word_spans(spaced)
    first = np.searchsorted(begin, begins)
    last = np.r_[first[1:], len(begin)]
    done: dict = {}

    def values(lane: int) -> np.ndarray:
        if lane not in done:
            done[lane] = lanes()[lane].segments(spaced, begin, end - begin)
        return done[lane]

    return values, first, last


def _units(data, starts, ends):
    values, first, last = words_of(data, starts, ends)
    return (lambda lane, size: lanes()[lane].windows(values(lane), size)), first, last, int(last[-1]) if len(last) else 0


def _pieces(size: int):
    def cut(data, most):
        begin, end = word_spans(data)
        out, at = [], 0
        while at < len(begin):
            n = max(1, int(np.searchsorted(begin, begin[at] + most)) - at)
            last = min(len(begin), at + n + size - 1) - 1
            out.append((at, int(begin[at]), int(end[last])))
            at += n
        return out

    return cut


def _repeated(payloads, counts):
    names = repeats.binary_bytes(payloads)[0].view(np.uint64).reshape(-1, 2)
    return repeats.equal_names(names)[0]


def kind_of(size: int = WINDOW) -> repeats.Kind:
    """Windows of `size` words, 8 at least."""
    gram = max(2, size * 2 // 7)
    return repeats.Kind(size, gram, max(2, min(12, size - gram)), 6.0, _units, _pieces(size), repeats._named, _repeated)


def remove_repeated_words(docs: DataFrame, size: int = WINDOW, text: bool = False, most: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; with text=True the kept words too.

    A null or empty text has no words. Rows alike lose all words that their windows cover, since
    each window starts in the other row too; an empty table gives no row; other columns are
    not read. A very long text is scanned in pieces, and only the last step, which gives it
    back, holds it whole. `most` bounds the bits of the sketch that is sent to executors.
    """
    rows = repeats.with_spans(pick(docs, "doc_id", "text"), kind_of(size), most)
    id_type = rows.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(id_type)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * text
    schema = pa.schema(fields)

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(at, 256)
                for key, value, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                    raw = (value or "").encode()
                    begin, end = word_spans(np.frombuffer(raw, np.uint8))
                    gone = repeats.removed(spans, len(begin), size)
                    kept = b" ".join([raw[a:b] for a, b in zip(begin[~gone].tolist(), end[~gone].tolist())])
                    out.append((key, len(begin), int(gone.sum()), hashlib.sha256(kept).hexdigest()) + (kept.decode(),) * text)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.select("doc_id", "text", "spans").mapInArrow(scan, f"doc_id {id_type.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)
