"""URL filters: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models of characters, one of accepted and one of rejected
URLs, are counted over all URLs that the rules decide. Every context that occurred is kept; its
prediction is interpolated with that of the next shorter context (Witten-Bell), down to a
uniform distribution. A URL's score is the difference of the two log-likelihoods divided by its
number of characters. The threshold is calibrated on a fold of the decided URLs that the models
haven't counted; if that fold lacks a kind, on all decided URLs.

The models grow with the table, so they are tables too. URLs are dealt into chunks of bounded
length; a chunk sends each of its distinct grams (a context and the byte after it) once, with
its counts, and gets the gram's log-ratio back, whatever the number of URLs that share it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import in_chunks, pick, stored, utf8

ORDER = 4
ALPHABET = 256
#: Bytes of URLs in a chunk; a longer URL is a chunk of its own.
CHUNK_BYTES = 1 << 16
FOLDS = 10
#: Stands for a fold that no url is in.
ALL_FOLDS = -1
#: Bins of the calibration's score histogram, over scores from -RANGE to RANGE.
BINS, RANGE = 4001, 8.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: on up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, such as net/es/, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]))):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


class Markov:
    """Counts of the byte after each context of up to ORDER bytes, interpolated."""

    def __init__(self, counts: dict):
        self.next: dict = {}
        for (context, byte), n in counts.items():
            self.next.setdefault(context, {})[byte] = n
        self.mass = {c: (sum(v.values()), len(v)) for c, v in self.next.items()}
        self.memo: dict = {}

    def log_probability(self, context: bytes, byte: int) -> float:
        key = (context, byte)
        if key not in self.memo:
            p = 1.0 / ALPHABET
            for k in range(len(context) + 1):
                own = self.next.get(context[len(context) - k :])
                if own is None:
                    break
                total, kinds = self.mass[context[len(context) - k :]]
                p = (own.get(byte, 0) + kinds * p) / (total + kinds)
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            self.memo[key] = math.log(p)
        return self.memo[key]


def score(url: str | None, accepted: Markov, rejected: Markov) -> float:
    """Log-likelihood under the accepted model less that under the rejected, per byte; 0 for an empty URL."""
    raw = (url or "").encode()
    total = 0.0
    for i, byte in enumerate(raw):
        context = raw[max(0, i - ORDER) : i]
        total += accepted.log_probability(context, byte) - rejected.log_probability(context, byte)
    return total / len(raw) if raw else 0.0


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The gram at each byte: a 1, then up to ORDER bytes before it in its URL, then the byte; rows have no gaps."""
    local = np.arange(len(data)) - np.repeat(starts, ends - starts)
    wide = data.astype(np.int64)
    out = wide + (np.int64(1) << 8 * (np.minimum(local, ORDER) + 1))
    for k in range(1, ORDER + 1):
        out[k:] += np.where(local[k:] >= k, wide[:-k] << 8 * k, 0)
    return out


_GRAMS = pa.schema([("chunk", pa.int64()), ("gram", pa.int64()), ("allow", pa.int64()), ("block", pa.int64())])


def _count(batches):
    for batch in batches:
        data, starts, ends = utf8(batch.column("url"))
        grams, chunk, learn = _grams(data, starts, ends), np.asarray(batch.column("chunk")), np.asarray(batch.column("learn").to_pylist(), object)
        edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(chunk) else [0]
        for i, j in zip(edge[:-1], edge[1:]):
            own = grams[starts[i] : ends[j - 1]]
            distinct, at = np.unique(own, return_inverse=True)
            counts = [np.bincount(at, np.repeat(learn[i:j] == k, ends[i:j] - starts[i:j]), len(distinct)).astype(np.int64) for k in ("allow", "block")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), chunk[i])), pa.array(distinct), *map(pa.array, counts)], schema=_GRAMS)


def count_grams(chunks: DataFrame) -> DataFrame:
    """From the columns chunk, url and learn: each chunk's distinct grams, and how often they occur in URLs that the models learn from."""
    return stored(chunks.select("chunk", "url", "learn").mapInArrow(_count, "chunk long, gram long, allow long, block long"))


def model(counted: DataFrame) -> DataFrame:
    """gram, allow and block: the counts of all grams and of their endings, those of no occurrence too."""
    whole = counted.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    g = F.col("gram")
    endings = F.array(*[F.when(g >= (1 << 8 * n), g.bitwiseAND((1 << 8 * n) - 1) + F.lit(1 << 8 * n)) for n in range(1, ORDER + 2)])
    ended = whole.select(F.explode(F.array_compact(endings)).alias("gram"), "allow", "block")
    return ended.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """gram and ratio, its log-probability under the accepted model less that under the rejected, for all counted grams."""
    context = W.partitionBy(F.shiftright("gram", 8))
    mass = {f"{k}_{what}": of.over(context) for k in ("allow", "block") for what, of in (("mass", F.sum(k)), ("kinds", F.count_if(F.col(k) > 0)))}
    known = stored(model(counted).withColumns(mass))
    levels: list[DataFrame] = []
    for n in range(1, ORDER + 2):
        own, low = known.where((F.col("gram") >= (1 << 8 * n)) & (F.col("gram") < (2 << 8 * n))), 1 << 8 * (n - 1)
        if levels:
            shorter = levels[-1].select(F.col("gram").alias("ending"), F.col("allow_p").alias("allow_q"), F.col("block_p").alias("block_q"))
            own = own.withColumn("ending", F.col("gram").bitwiseAND(low - 1) + F.lit(low)).join(shorter, "ending")
        else:
            own = own.withColumns({"allow_q": F.lit(1.0 / ALPHABET), "block_q": F.lit(1.0 / ALPHABET)})
        p = {k: F.when(F.col(f"{k}_mass") == 0, F.col(f"{k}_q")).otherwise((F.col(k) + F.col(f"{k}_kinds") * F.col(f"{k}_q")) / (F.col(f"{k}_mass") + F.col(f"{k}_kinds"))) for k in ("allow", "block")}
        levels.append(stored(own.select("gram", p["allow"].alias("allow_p"), p["block"].alias("block_p"))))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def _scored(names: list[str], schema: pa.Schema):
    def scan(chunk: pa.Table, ratios: pa.Table) -> pa.Table:
        data, starts, ends = utf8(chunk.column("url"))
        gram, ratio = np.asarray(ratios.column("gram")), np.asarray(ratios.column("ratio"))
        order, n = np.argsort(gram), ends - starts
        at = order[np.searchsorted(gram, _grams(data, starts, ends), sorter=order)]
        sums = np.bincount(np.repeat(np.arange(len(n)), n), ratio[at], len(n))
        return pa.Table.from_arrays([*(chunk.column(c) for c in names), pa.array(sums / np.maximum(n, 1))], schema=schema)

    return scan


def with_score(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """chunks with the column score, 0 for an empty URL; counted are its grams."""
    ratios = counted.select("chunk", "gram").join(log_ratios(counted), "gram")
    out = chunks.withColumn("score", F.lit(0.0).cast("double"))
    return chunks.groupBy("chunk").cogroup(ratios.groupBy("chunk")).applyInArrow(_scored(chunks.columns, to_arrow_schema(out.schema)), out.schema)


def train(decided: DataFrame) -> dict:
    """{verdict: Markov} on the driver from the columns url and verdict of a small table; tables are scored by log_ratios."""
    counted = count_grams(in_chunks(decided.select("url", F.col("verdict").alias("learn")), "url", CHUNK_BYTES))
    out: dict = {}
    for r in model(counted).collect():
        raw = r["gram"].to_bytes(ORDER + 2, "big").lstrip(b"\0")[1:]
        for k in ("allow", "block"):
            if r[k]:
                out.setdefault(k, {})[(raw[:-1], raw[-1])] = r[k]
    return {k: Markov(v) for k, v in out.items()}


def calibrate(histogram: list[tuple[int, str, int]]) -> float:
    """The score at and above which to allow: it balances the errors of both kinds best; ties take the lowest."""
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for at, verdict, n in histogram:
        (good if verdict == "allow" else bad)[at] += n
    if not good.sum() or not bad.sum():
        return -math.inf
    wrong = np.r_[0, np.cumsum(good)] / good.sum() + (bad.sum() - np.r_[0, np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[len(best) // 2] - BINS // 2) * 2 * RANGE / BINS)


def held_fold(counts: list[tuple[int, str, int]]) -> int | None:
    """The fold to set the threshold on, of (fold, verdict, urls): ALL_FOLDS if none will do, None if one kind is missing."""
    kinds = {fold: {v for f, v, _ in counts if f == fold} for fold, _, _ in counts}
    if {v for _, v, _ in counts} != {"allow", "block"}:
        return None
    for fold in sorted(kinds):
        if len(kinds[fold]) == 2 and len(set().union(*(k for f, k in kinds.items() if f != fold))) == 2:
            return fold
    return ALL_FOLDS


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score for each page.

    The rules decide where one fits; elsewhere the models do. A null or empty url fits no
    rule and scores 0. If the rules decide urls of one kind only, there is nothing to compare, and all others are
    allowed. The threshold is set on a fold that the models haven't counted, the first one that has both kinds and
    leaves both for the models; where there is none, models and threshold alike are made of all decided urls. Repeated rows count as often as they occur; an empty table
    gives no row; other columns are not read. A very long url is a chunk of its own, whole.
    """
    page = pick(pages, "page_id", "url")
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    page = page.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    page = page.withColumns({"rule": rule, "verdict": verdict, "url": F.coalesce("url", F.lit("")), "fold": fold})
    held = held_fold([tuple(r) for r in page.where("verdict is not null").groupBy("fold", "verdict").count().collect()])
    if held is None:
        return page.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    chunks = in_chunks(page.withColumn("learn", F.when(F.col("fold") != held, F.col("verdict"))), "url", CHUNK_BYTES)
    judged = stored(with_score(chunks, count_grams(chunks)))
    tested = judged.where("verdict is not null").where((F.col("fold") == held) | F.lit(held == ALL_FOLDS))
    at = F.floor((F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) * (BINS / (2 * RANGE))) + F.lit(BINS / 2)).cast("int")
    bins = tested.select(F.least(at, F.lit(BINS - 1)).alias("bin"), "verdict").groupBy("bin", "verdict").count().collect()
    threshold = calibrate([(r["bin"], r["verdict"], r["count"]) for r in bins])
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when((F.col("score") >= threshold) | (F.length("url") == 0), "allow").otherwise("block")).alias("verdict"), "score")
