import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

langid = pytest.importorskip("colloquy.llm.langid")
from colloquy.llm import queries as Q  # noqa: E402
from colloquy.llm import tiff, urls, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_gradients_are_those_of_the_loss():
    net = langid.Network(3, seed=2, hidden=4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    text, langs = rng.integers(97, 103, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    grads, _ = net.gradients(text, langs)
    for name, w in net.weights.items():
        at = (int(text[3, 2]), 1) if name[0] == "x" else tuple(0 for _ in w.shape)
        keep, losses = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = keep + step
            losses.append(net.gradients(text, langs)[1])
        w[at] = keep
        assert abs(grads[name][at] - (losses[0] - losses[1]) / 2e-3) < 1e-3


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Q.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 !", None, "x"), (None, "the of", "en", "x"), (5, "der die " * 9, "de", "x"), (6, "the of " * 9, "en", "x")], "doc_id long, text string, lang string, Text2 string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] in ("de", "en")
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_positions_are_labelled():
    net = langid.train([("der die und " * 20, "de"), ("the of and " * 20, "en")] * 8, ["de", "en"])
    runs = langid.label_positions("the of and the of and", net, ["de", "en"])
    assert runs[0][0] == 0 and runs[-1][1] == 21 and max(runs, key=lambda r: r[1] - r[0])[2] == "en"


def test_probabilities_are_those_of_a_plain_pass():
    net, h = langid.Network(3, seed=4), langid.HIDDEN
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    raw = np.random.default_rng(1).integers(97, 123, 2 * langid.SEGMENT + 77).astype(np.uint8)
    soft = lambda x: x / (1 + np.abs(x))

    def plain(side, text):
        """States of one layer over a whole text, position by position."""
        state, out = np.zeros(h), []
        for byte in text if side == "f" else text[::-1]:
            p, x = state @ w["u" + side], w["x" + side][byte]
            z, r = (0.5 + 0.5 * soft(x[i * h : (i + 1) * h] + p[i * h : (i + 1) * h]) for i in (0, 1))
            new = soft(r * p[2 * h :] + x[2 * h :])
            state = new + z * (state - new)
            out.append(state)
        return np.array(out if side == "f" else out[::-1])

    for n in (1, 5, langid.SEGMENT, len(raw)):
        text, m, s = raw[:n], langid.MARGIN, langid.SEGMENT
        states = np.zeros((n, 2 * h))
        for a in range(0, n, s):
            low, high = max(0, a - m), min(n, a + s + m)
            part = np.concatenate((plain("f", text[low:high]), plain("b", text[low:high])), axis=1)
            states[a : a + s] = part[a - low : a - low + s]
        logits = states @ w["v"] + w["c"]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        got = [q.transpose(1, 0, 2)[np.arange(s) < length[:, None]] for _, length, q in langid.labelled(net, text, np.array([0]), np.array([n]))]
        assert np.abs(np.concatenate(got) - p).max() < 1e-4
        assert np.abs(langid.pooled(net, text, np.array([0]), np.array([n])) - p.mean(axis=0)).max() < 1e-4


def test_hosts_paths_and_rules(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/a?b#c"), (2, "http://example.com/en/"), (3, "x://a.net/es/"), (4, "x://a.net/esp"), (5, None), (6, "no host"), (7, "http://example.com"), (8, "a://b://c/d"), (9, "http://notexample.com/en/x")]
    page = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(page, Q.URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/", "example.com/en/", "block") and got[3][2:] == ("net/es/", "block")
    assert got[4][2] is None and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7][:3] == ("example.com", "", None) and got[8][:2] == ("b:", "//c/d") and got[9][2] == "com/"
    assert urls.filter_urls(page.limit(0), Q.URL_RULES).count() == 0


def test_scores_are_those_of_a_plain_model(spark):
    seen = ["aab", "aac", "ab"]
    df = spark.createDataFrame([(u, "allow") for u in seen], "url string, verdict string")
    model = urls.train(df)["allow"]
    counts = {}
    for u in seen:
        raw = u.encode()
        for i, b in enumerate(raw):
            for k in range(min(i, urls.ORDER) + 1):
                counts.setdefault(raw[i - k : i], []).append(b)

    def plain(context, byte):
        p = 1 / 256
        for k in range(len(context) + 1):
            own = counts.get(context[len(context) - k :])
            if own is None:
                break
            p = (own.count(byte) + len(set(own)) * p) / (len(own) + len(set(own)))
        return p

    for context, byte in ((b"", 97), (b"a", 98), (b"aa", 99), (b"xa", 97), (b"zz", 1)):
        assert abs(model.log_probability(context, byte) - np.log(plain(context, byte))) < 1e-12


def test_rare_contexts_count_in_every_score(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    rows = [(i, f"http://a.{('com/', 'net/es/', 'org/')[i % 3]}{name()}") for i in range(900)] + [(900, None), (901, "é"), (902, "http://a.org/" + "q" * urls.CHUNK_BYTES), (903, "http://a.com/" + name())]
    page = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["url"], r["verdict"], r["score"], r["fold"]) for r in urls.filter_urls(page, Q.URL_RULES).join(page.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS))), "page_id").collect()}
    counts = {"allow": {}, "block": {}}
    for url, verdict, _, fold in got.values():
        if url and fold and ("a.com/" in url or "net/es/" in url):
            raw = url.encode()
            for i, byte in enumerate(raw):
                for k in range(min(i, urls.ORDER) + 1):
                    key = (raw[i - k : i], byte)
                    counts[verdict][key] = counts[verdict].get(key, 0) + 1
    plain = [urls.Markov(counts[k]) for k in ("allow", "block")]
    assert len(got) == len(rows) and got[900][1:3] == ("allow", 0.0)
    assert all(abs(score - urls.score(url, *plain)) < 1e-9 for url, _, score, _ in got.values())


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(how):
    rng = np.random.default_rng(how)
    pages = [rng.integers(0, 3, (h, w), dtype=np.uint8) for h, w in ((1, 1), (70, 33), (300, 64))]
    for order in "<>":
        for predictor in (False, True):
            for tile in (0, 16):
                got = [g[:, :, 0] for _, g in tiff.iter_pages(tiff.write_tiff(pages, how, predictor, tile, 7, order))]
                assert all((a == b).all() for a, b in zip(got, pages)) and len(got) == 3


def test_lzw_of_all_lengths():
    rng = random.Random(1)
    for n in [*range(0, 40), 500, 4000, 30000]:
        data = bytes(rng.choices(range(97, 123), k=n))
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def test_media_digests_are_those_of_the_text(spark):
    docs = spark.createDataFrame([(1, "a" * 64), (2, None), (3, ""), (4, "é" * 5000), (5, "a" * 64), (None, "x")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tiff.media_digests(tiff.write_media(docs)).collect()}
    for r, (key, text) in ((rows[k], (k, t)) for k, t in docs.collect()):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert rows[1].asDict() | {"doc_id": 5} == rows[5].asDict()
    assert tiff.read_pages(tiff.write_media(docs), "doc_id", "media").count() == 6
    assert tiff.media_digests(tiff.write_media(docs.limit(0))).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_are_read_as_written(spark):
    rows = [(1, "http://b.com/x y", "same"), (2, "http://a.com/", "same"), (3, None, None), (4, "http://a.com/", ""), (5, "http://a.com/", "é\r\n\r\nx"), (6, "http://b.com/", "same")]
    page = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.capture_histories(page).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert [got[k]["payload_bytes"] for k in (1, 3, 5)] == [4, 0, 7]
    order = [(r["url_key"], r["timestamp"]) for r in sorted(got.values(), key=lambda r: (r["range"], r["position"]))]
    assert order == sorted(order) and warc.capture_histories(page.limit(0)).count() == 0
    all_own = {r["record_type"] for r in warc.capture_histories(page, least_bytes=5).collect()}
    assert all_own == {"response"}
