"""Quality rules: base rules, then distribution divergence from language references.

A document is compared with the reference of its language in two histograms, by
Jensen-Shannon distance (base 2): character classes, and common words with one bin for
all other words. A word is common in a language if at least one in COMMON of that
language's words is it. Histograms shorter than a guard are not judged.

Common words are found exactly in two scans. Each bounded chunk of text reports words with
at least half that share of the chunk; a word that is common overall then has at least
half its share reported, so 2 * COMMON candidates a language are enough, and a second
scan counts just these, in every language. No scan keeps more than a chunk's words.
A language of few words has no reference of its own; its documents are compared with all
languages together. A word that is common in all together is so in one of them at least.

Texts of more than STEP_BYTES are scanned in pieces that end at white space, so memory is
a few times the longest text at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import STEP_BYTES, lanes, pick, plain, steps, stored, utf8, word_spans

COMMON = 500
MIN_CHARS = 200
MIN_WORDS = 100
#: A language of fewer words than this is judged by the reference of all languages; a table of fewer words isn't judged.
MIN_REFERENCE_WORDS = 5000
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.36

# Character classes of the histogram, by code point; the last is all others.
CLASSES = ("a-z", "A-Z", "0-9", "\\x20\\x09-\\x0D", ".,;:!?'\"()-", "\\x80 and above", "others")
SYMBOLS = b"[#*$%&|<>]"


def class_table() -> np.ndarray:
    """Class of each UTF-8 byte; 7 marks continuation bytes, which count for nothing."""
    table = np.full(256, 6, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[0x20, *range(0x09, 0x0E)]] = 3
    table[list(b".,;:!?'\"()-")] = 4
    table[0x80:0xC0] = 7
    table[0xC0:] = 5
    return table


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms of counts."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    inner = (p[a] * np.log2(p[a] / m[a])).sum() / 2 + (q[b] * np.log2(q[b] / m[b])).sum() / 2
    return float(np.sqrt(max(inner, 0.0)))


def _langs(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    return [*names, None], np.array([len(names) if x is None else x for x in coded.indices.to_pylist()], np.int64)


def _words(data, starts, ends):
    """The bytes with a space after each row, spans of words in them, their hash, and their row."""
    shift = np.arange(len(starts), dtype=np.int64)
    spaced = np.full(len(data) + len(starts), 0x20, np.uint8)
    keep = np.ones(len(spaced), bool)
    keep[ends + shift] = False
    spaced[keep] = data
    begin, end = word_spans(spaced)
    row = np.searchsorted(starts + shift, begin, "right") - 1
    return spaced, begin, end, lanes()[0].segments(spaced, begin, end - begin), row


def _cuts(text: np.ndarray) -> list[int]:
    """Places that cut a text into pieces of about STEP_BYTES, each after white space; a longer word is not cut."""
    cuts, at = [0], STEP_BYTES
    while at < len(text):
        while at < len(text):
            blank = np.flatnonzero(np.isin(text[at : at + 4096], list(b" \t\n\v\f\r")))
            if len(blank):
                at += int(blank[0]) + 1
                break
            at += 4096
        cuts.append(min(at, len(text)))
        at += STEP_BYTES
    return cuts if cuts[-1] == len(text) else [*cuts, len(text)]


def _rows(batch):
    """(first row, data, starts, ends) of steps: some whole rows, or a piece of a long one."""
    data, starts, ends = utf8(batch.column("text"))
    for i, j in steps(starts, ends):
        part = data[starts[i] : ends[j - 1]]
        if j == i + 1 and len(part) > STEP_BYTES:
            cuts = _cuts(part)
            for a, b in zip(cuts, cuts[1:]):
                yield i, part[a:b], np.array([0]), np.array([b - a])
        else:
            yield i, part, starts[i:j] - starts[i], ends[i:j] - starts[i]


def _report(batches):
    for batch in batches:
        names, lang = _langs(batch)
        for i, data, starts, ends in _rows(batch):
            spaced, begin, end, hashes, row = _words(data, starts, ends)
            of = lang[i + row]
            totals = np.bincount(of, minlength=len(names))
            out = [(names[k], None, int(totals[k])) for k in np.flatnonzero(totals)]
            order = np.lexsort((hashes, of))
            h, o = hashes[order], of[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, int)
            counts = np.diff(np.r_[first, len(h)])
            for k in np.flatnonzero(2 * COMMON * counts >= totals[o[first]]):
                at = order[first[k]]
                out.append((names[o[first[k]]], spaced[begin[at] : end[at]].tobytes().decode("utf-8", "replace"), int(counts[k])))
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), x)) for x in out], _REPORT)


_REPORT = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _wanted(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The words' sorted hashes, and the words in that order."""
    raw = [w.encode() for w in words]
    size = np.array([len(x) for x in raw], np.int64)
    h = lanes()[0].segments(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
    order = np.argsort(h)
    return h[order], [words[x] for x in order]


def _found(sought: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are sought, and their places."""
    if not len(sought):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sought, hashes), len(sought) - 1)
    known = sought[at] == hashes
    return known, at[known]


def _count(candidates: list[str]):
    def scan(batches):
        (sought, words), table, sums = _wanted(candidates), class_table(), {}
        for batch in batches:
            names, lang = _langs(batch)
            for i, data, starts, ends in _rows(batch):
                _, _, _, hashes, row = _words(data, starts, ends)
                known, at = _found(sought, hashes)
                of = lang[i + row][known]
                by_byte = np.repeat(lang[i : i + len(starts)], ends - starts)
                for k in np.unique(lang[i : i + len(starts)]):
                    own = sums.setdefault(names[k], (np.zeros(len(words), np.int64), np.zeros(8, np.int64)))
                    own[0][:] += np.bincount(at[of == k], minlength=len(words))
                    own[1][:] += np.bincount(table[data[by_byte == k]], minlength=8)
        out = [{"lang": k, "word": words[x], "klass": -1, "n": int(v[x])} for k, (v, _) in sums.items() for x in np.flatnonzero(v)]
        out += [{"lang": k, "word": None, "klass": c, "n": int(n)} for k, (_, v) in sums.items() for c, n in enumerate(v[:7]) if n]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("word", pa.string()), ("klass", pa.int32()), ("n", pa.int64())]))

    return scan


#: The name, in references(), of all languages together.
TOGETHER = ("all languages",)


def references(docs: DataFrame) -> dict:
    """{lang: (character class counts, common words, their counts, words in all)} over all documents, and the same for TOGETHER.

    What reaches the driver is bounded by the number of languages times 2 * COMMON words.
    """
    texts = pick(docs, "text", "lang").where("text is not null")
    reported = stored(texts.mapInArrow(_report, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = stored(reported.where("word is null").select(F.col("lang").alias("l"), F.col("n").alias("total")))
    heavy = reported.where("word is not null").join(totals, F.col("lang").eqNullSafe(F.col("l"))).where(2 * COMMON * F.col("n") >= F.col("total"))
    candidates = [r["word"] for r in heavy.select("word").distinct().collect()]
    counted = texts.mapInArrow(_count(candidates), "lang string, word string, klass int, n long").groupBy("lang", "word", "klass").agg(F.sum("n").alias("n"))
    counted = stored(counted.join(totals, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l"))
    out = {r["l"]: (np.zeros(7), [], [], r["total"]) for r in totals.collect()}
    everything = sum(x[3] for x in out.values())
    common = counted.where((F.col("klass") >= 0) | (COMMON * F.col("n") >= F.col("total")))
    pooled = counted.groupBy("word", "klass").agg(F.sum("n").alias("n")).where((F.col("klass") >= 0) | (COMMON * F.col("n") >= everything))
    out[TOGETHER] = (np.zeros(7), [], [], everything)
    rows = [(r["lang"], r["word"], r["klass"], r["n"]) for r in common.collect()] + [(TOGETHER, r["word"], r["klass"], r["n"]) for r in pooled.collect()]
    for lang, word, klass, n in sorted(rows, key=lambda r: r[1] or ""):
        chars, words, counts, _ = out.setdefault(lang, (np.zeros(7), [], [], 0))
        if klass >= 0:
            chars[klass] = n
        else:
            words.append(word)
            counts.append(n)
    return out


def _repeats(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row inside 3-word windows that the row holds twice or more."""
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    w = lanes()[1].windows(hashes, 3)
    of, inside = row[: len(w)], row[2:] == row[: len(w)]
    at = np.flatnonzero(inside)
    order = at[np.lexsort((w[at], of[at]))]
    same = (w[order][1:] == w[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(hashes) + 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = twice[: len(hashes)].copy()
    covered[1:] |= twice[: len(hashes) - 1]
    covered[2:] |= twice[: len(hashes) - 2]
    return np.bincount(row[covered], minlength=n)


def _repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return n


def _verdicts(refs: dict, batches):
    """(rows, five counts, base_failed, kept) for batches of the rows, in order."""
    table = class_table()
    wanted = {k: _wanted(v[1]) for k, v in refs.items()}
    counts = {k: np.array([dict(zip(v[1], v[2]))[w] for w in wanted[k][1]], np.float64) for k, v in refs.items()}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS[1:-1])] = True
    for batch in batches:
        names, lang = _langs(batch)
        texts, n = batch.column("text"), batch.num_rows
        chars, symbols, classes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 8), np.int64)
        all_hashes, all_rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, data, starts, ends in _rows(batch):
            m = len(starts)
            spaced, begin, end, hashes, row = _words(data, starts, ends)
            lead = np.r_[0, np.cumsum((spaced & 0xC0) != 0x80)]
            doc = np.repeat(np.arange(m), ends - starts)
            chars[i : i + m] += np.bincount(row, lead[end] - lead[begin], minlength=m).astype(np.int64)
            symbols[i : i + m] += np.bincount(doc[symbol[data]], minlength=m)
            classes[i : i + m] += np.bincount(doc * 8 + table[data], minlength=8 * m).reshape(m, 8)
            all_hashes.append(hashes)
            all_rows.append(i + row)
        hashes, row = np.concatenate(all_hashes), np.concatenate(all_rows)
        n_words, repeats = np.bincount(row, minlength=n), _repeats(hashes, row, n)
        lines = [_repeated_lines(x.as_py() or "") for x in texts]
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        bounds = np.searchsorted(row, np.arange(n + 1))
        kept = ~failed
        for d in np.flatnonzero(kept):
            name = names[lang[d]]
            if name not in refs or refs[name][3] < MIN_REFERENCE_WORDS:
                name = TOGETHER
            chars_ref, words_ref, _, total = refs[name]
            if total < MIN_REFERENCE_WORDS:
                continue
            own = classes[d, :7]
            if own.sum() >= MIN_CHARS and divergence(own.astype(float), chars_ref) > MAX_CHAR_DISTANCE:
                kept[d] = False
            elif n_words[d] >= MIN_WORDS and words_ref:
                hist = np.bincount(_found(wanted[name][0], hashes[bounds[d] : bounds[d + 1]])[1], minlength=len(words_ref)).astype(float)
                p, q = np.append(hist, n_words[d] - hist.sum()), np.append(counts[name], total - counts[name].sum())
                kept[d] = divergence(p, q) <= MAX_WORD_DISTANCE
        yield batch, (n_words, chars, symbols, lines, repeats), failed, kept


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each document.

    A null or empty text has no words and so fails. Null lang is a language of its own.
    Repeated rows are judged alike; an empty table gives no row; other columns are not read.
    Very long texts are scanned whole, in pieces.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    refs, kind = references(docs), rows.schema["doc_id"].dataType
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((k, pa.int64()) for k in names), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def scan(batches):
        for part, counted, failed, kept in _verdicts(refs, batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in counted), pa.array(failed), pa.array(kept)], schema=schema)

    return rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever those are called.

    A null text goes, as it has no words; of repeated rows all stay or all go; an empty table
    gives no row.
    """
    refs, own = references(docs), plain(docs, "text", "lang")

    def scan(batches):
        for part, _, _, kept in _verdicts(refs, batches):
            yield part.filter(pa.array(kept))

    return own.mapInArrow(scan, own.schema).toDF(*docs.columns)
