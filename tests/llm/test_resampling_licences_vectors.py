"""Importance resampling, licence scans and vector codes against plain versions, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

importance = pytest.importorskip("colloquy.llm.importance")
from colloquy.llm import licenses, quality, vectors  # noqa: E402
from colloquy.llm import queries as Q  # noqa: E402
from tests.llm.test_edges import clashing  # noqa: E402
from tests.oracle import SF_DIR  # noqa: E402

LATIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return LATIN.findall((text or "").translate(LOWER))


def texts(seed):
    rng = random.Random(seed)
    pool = ["Mit", "license", "the", "GNU", "general", "public", "Ärger", "ÄRGER", "日本", "x" * 40, "y" * 31, "z" * 32, "a1", "cc", "BY", "apache"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(60)]
    return [*rows, (90, None), (91, ""), (92, "...,--"), (None, "mit license " * 12), (None, "mit license " * 12), (93, rows[3][1]), (93, rows[3][1]), (94, "the cc by " * 30000)]


def plain_resample(rows, target, n, buckets, seed, min_words, percent):
    def grams(text):
        w = words_of(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)))
    for text in target:
        t.update(map(bucket, grams(text)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out = []
    for key, text in rows:
        g = grams(text)
        weight = sum(gain(bucket(x)) for x in g)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    first = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(first[: percent * len(first) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10000, 10), (3, 97, 40), (2, 10000, 100)])
def test_resampling_equals_plain_counting(spark, monkeypatch, n, buckets, percent):
    if n > 1:  # long texts in many pieces
        monkeypatch.setattr(quality, "STEP_BYTES", 5000)
    rows, target = texts(n), [r[1] for r in texts(7)[:9]] + [None, ""]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, 11, 12, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, n, buckets, 11, 12, percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    rows = importance.resample(spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string"), none, percent=100).collect()
    assert {r.doc_id: (r.n_features, r.rank) for r in rows} == {1: (30, 1), 2: (0, None)}


def test_table_keeps_strings_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(importance, "xxh64", lambda data, begin, lengths: np.full(len(begin), 7, np.uint64))
    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 6))) for _ in range(4000)]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    table = importance.Interned(1000, bits=3)
    seen = Counter()
    for a in range(0, 4000, 500):
        part = slice(a, a + 500)
        slot = table.slots(data, (np.cumsum(size) - size)[part], size[part])
        seen.update(words[part])
        assert [table.bytes[table.begin[s] : table.begin[s] + table.length[s]].tobytes() for s in slot.tolist()] == words[part]
        assert table.bucket[slot].tolist() == [zlib.crc32(w) % 1000 for w in words[part]]
    live = table.length >= 0
    assert table.used == len(seen) == live.sum() and sorted(table.count[live].tolist()) == sorted(seen.values())


def test_hash_is_xxh64():
    rng = random.Random(4)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 70) for _ in range(5)]
    data, size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    assert importance.xxh64(data, np.cumsum(size) - size, size).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]


def test_matching_statistics_and_places_equal_plain_search(monkeypatch):
    monkeypatch.setattr(licenses, "RUN_WORDS", 7)  # runs are cut
    rng = random.Random(2)
    for _ in range(40):
        given = [" ".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(5)]
        known = licenses.Templates([(t, "p") for t in given[:2]], [(t, "t") for t in given[2:]])
        seq = rng.choices("abcabcabcx", k=60)
        row = np.repeat([0, 1], 30)
        raw = np.frombuffer(" ".join(seq).encode(), np.uint8)
        numbers = known.numbers_of(raw, np.arange(60) * 2, np.arange(60) * 2 + 1)
        state, length = known.statistics(numbers, row)
        for i in range(60):
            low = 30 * row[i]
            fits = [i + 1 - k for k in range(low, i + 1) if any(f" {' '.join(seq[k : i + 1])} " in f" {t} " for t in given)]
            assert length[i] == max(fits, default=0)
        for p, last in known.places(state, length):
            want = given[p].split()
            assert last.tolist() == [i for low in (0, 30) for i in range(low + len(want) - 1, low + 30) if seq[i - len(want) + 1 : i + 1] == want]


MIT = licenses.TEMPLATES[11][0]


def plain_base(text):
    w = words_of(text)
    hits = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.mark.parametrize("step", [1 << 19, 700])
def test_licence_scan_equals_plain_search_of_phrases(spark, monkeypatch, step):
    monkeypatch.setattr(quality, "STEP_BYTES", step)
    rows = [*texts(3), (95, "GNU General-Public  License gnu general public license cc by by mit.license apache,LICENSE"), (96, f"prose before. {MIT} prose behind"), (97, " ".join(["filler words"] * 20000) + " apache license " + MIT)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted((tuple(r) for r in licenses.scan_licences(docs).collect()), key=str)
    assert sorted(((r[0], *r[1:6]) for r in got), key=str) == sorted(((k, *plain_base(t)) for k, t in rows), key=str)
    by_id = {r[0]: r for r in got}
    assert by_id[96][6:] == ("mit-text", 1.0) and by_id[97][6:] == ("apache,mit-text", 1.0) and by_id[95][6] == "apache,cc-by,gpl,mit" and by_id[90][6:] == ("", 0.0)
    assert licenses.scan_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spans_survive_changes_and_cover_what_is_left(spark):
    words = MIT.split()
    changed = [w for i, w in enumerate(words) if i % 23 != 22]  # a word in 23 is lost
    swapped = ["other" if i % 17 == 16 else w for i, w in enumerate(words)]
    half = words[: len(words) // 2]
    docs = [(1, " ".join(["lead"] * 5 + changed)), (2, " ".join(swapped + ["gap"] * 40 + swapped)), (3, " ".join(half)), (4, "Released under the MIT License.  Licensed under CC BY-NC 4.0."), (5, " ".join(reversed(words)))]
    spans = {}
    for r in licenses.licence_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        spans.setdefault(r.doc_id, []).append(r)
    one = [r for r in spans[1] if r.label == "mit-text"]
    assert len(one) == 1 and one[0].first_word == 5 and one[0].end_word == 5 + len(words_of(" ".join(changed))) and one[0].share > 0.9
    assert [r.share > 0.85 for r in spans[2] if r.label == "mit-text"] == [True, True]
    three = [r for r in spans[3] if r.label == "mit-text"]
    assert len(three) == 1 and 0.4 < three[0].share < 0.6
    assert {r.label for r in spans[4] if r.share == 1} == {"mit-grant", "cc-by-nc-4.0"} and 5 not in spans
    labels = {r.doc_id: r.labels for r in licenses.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert labels == {1: "mit-text", 2: "mit-text", 3: "", 4: "cc-by,cc-by-nc-4.0,mit,mit-grant", 5: ""}


def test_licence_scan_of_documents_equals_plain_search(spark):
    rows = [(r.doc_id, r.text) for r in Q.table(spark, SF_DIR, "documents").collect()]
    got = sorted((tuple(r)[:6] for r in Q.op12_license_scans(spark, SF_DIR).collect()), key=str)
    assert got == sorted(((k, *plain_base(t)) for k, t in rows), key=str)


def plain_codes(rows, parts, entries, rounds):
    kept = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(min(max(x, -vectors.MOST), vectors.MOST) * 1024) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))
    books = [[list(cut[p][i]) for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda k: (far(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, books[p]) for v in cut[p]]
            for k in set(own):
                mine = [v for v, o in zip(cut[p], own) if o == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    codes = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    error = [sum(far(cut[p][i], books[p][codes[i][p]]) for p in range(parts)) for i in range(len(kept))]
    total = Counter()
    for (_, _, label), e in zip(kept, error):
        total[label] += e
    top = (1 << 63) - 1
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    capped = Counter()
    for (_, _, label), e in zip(kept, error):
        capped[label] += min(e, top)
    return sorted(((k, "".join(f"{c:02x}" for c in code), min(e, top), min(capped[label], top), digest) for (k, _, label), code, e in zip(kept, codes, error)), key=str)


@pytest.mark.parametrize(("spread", "entries"), [(1.0, 8), (1e-3, 5), (1e6, 8), (3e38, 4)])
def test_codes_equal_plain_rounds(spark, spread, entries):
    rng = random.Random(int(spread))
    made = lambda: [float(np.float32(rng.uniform(-1, 1) * spread)) for _ in range(8)]
    rows = [(i, made(), rng.choice([1, 2, None])) for i in range(70)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [1.0] * 7 + [float("nan")], 1), (203, [float("inf")] * 8, 2), (204, rows[0][1], 3), (204, rows[0][1], 3), (None, rows[1][1], None), (1 << 62, made(), 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    got = vectors.compress_vectors(df, 4, entries, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, 4, entries, 3)


def test_codes_of_few_and_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert vectors.compress_vectors(spark.createDataFrame([], ddl)).collect() == []
    assert vectors.compress_vectors(spark.createDataFrame([(1, None, 1)], ddl)).collect() == []
    rows = vectors.compress_vectors(spark.createDataFrame([(5, [1.0] * 4, 1), (3, [2.0] * 4, 1)], ddl)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in rows} == {3: ("00000000", 0, 0), 5: ("01010101", 0, 0)}
    with pytest.raises(ValueError):
        vectors.compress_vectors(spark.createDataFrame([(1, [1.0] * 6, 1)], ddl))


def test_limbs_give_exact_products():
    rng = np.random.default_rng(3)
    for top, dim in ((1 << 10, 16), (1 << 26, 16), (1 << 28, 3), (1, 1), (1 << 20, 4096)):
        x, c = rng.integers(-top, top + 1, (50, dim)), rng.integers(-top, top + 1, (20, dim))
        want = x.astype(object) @ c.astype(object).T
        assert (vectors.exact_dots(x, c) == want).all()
    with pytest.raises(ValueError):
        vectors.compress_vectors(None, entries=300)
