"""Call logs: sessions, pairs of request and outcome, reuse of answers, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize_log(log: DataFrame, by: str = "caller_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """log with session: a request counter that falls back opens a new one; rows without a counter belong to the session open then."""
    w = W.partitionBy(by).orderBy(*order)
    before = F.last("request_count", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    fell = F.when(F.col("request_count") < before, 1).otherwise(0)
    return log.withColumn("fell", fell).withColumn("session", F.sum("fell").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("fell")


def pair_log_calls(log: DataFrame, by: str = "caller_id") -> DataFrame:
    """Each request of a sessionised log with its outcome (success or fallback) and latency; null without one."""
    keys = [by, "session", "request_count"]
    asked = log.where("event = 'request'").select(*keys, F.col("ts").alias("asked_ts"), F.col("query"))
    got = log.where("event in ('success', 'fallback')").groupBy(*keys).agg(F.min("ts").alias("done_ts"), F.min_by("event", "ts").alias("outcome"))
    return asked.join(got, keys, "left").withColumn("latency", F.round(F.col("done_ts") - F.col("asked_ts"), 6))


def cached_responses(prompts: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("query", "k"), order: tuple[str, ...] = ("ts", "event_id"), width: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """(hits, distinct misses): a hit is a prompt with the latest response to its keys that was there before it; only misses go to a model.

    prompts have keys and order columns, the first of which is a number; cache has response besides; hits add response
    and answered, its time. An answer counts for prompts behind it in the merged order. Time is cut into slices of
    `width`: a slice's prompts look into their own slice, then at the last answer of the slices before, so no task
    sorts all calls of a frequent key.
    """
    at = order[0]
    slice_ = F.floor(F.col(at) / width)
    none = cache.schema["response"].dataType
    asked = prompts.withColumns({"slice": slice_, "answer": F.lit(None).cast(f"struct<response:{none.simpleString()},answered:{cache.schema[at].dataType.simpleString()}>")})
    given = cache.select(*keys, *order, slice_.alias("slice"), F.struct("response", F.col(at).alias("answered")).alias("answer")).withColumn("given", F.lit(True))
    # The last answer of each slice, then of all slices before: one row for each key and slice.
    last = given.groupBy(*keys, "slice").agg(F.max_by("answer", F.struct(*order)).alias("answer"))
    slices = last.unionByName(asked.select(*keys, "slice").distinct().withColumn("answer", F.lit(None).cast(last.schema["answer"].dataType)))
    slices = slices.groupBy(*keys, "slice").agg(F.first("answer", ignorenulls=True).alias("answer"))
    before = F.last("answer", ignorenulls=True).over(W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    carried = slices.select(*keys, "slice", before.alias("earlier"))
    merged = asked.withColumn("given", F.lit(False)).unionByName(given, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = merged.withColumn("here", F.last("answer", ignorenulls=True).over(inside)).where(~F.col("given")).join(carried, [*keys, "slice"], "left")
    found = seen.withColumn("got", F.coalesce("here", "earlier")).drop("slice", "answer", "given", "here", "earlier")
    hits = found.where(F.col("got").isNotNull()).select(*prompts.columns, "got.response", "got.answered")
    return hits, found.where(F.col("got").isNull()).select(*keys).distinct()


def log_summary(log: DataFrame, by: str = "caller_id") -> DataFrame:
    """Per session: calls by kind, the share of hits, latencies and tokens."""
    keys = [by, "session"]
    counts = log.groupBy(*keys).agg(*(F.count_if(F.col("event") == e).alias(n) for e, n in (("request", "requests"), ("success", "successes"), ("fallback", "fallbacks"), ("cache_hit", "cache_hits"))), F.sum("estimated_input_tokens").alias("tokens"))
    pairs = pair_log_calls(log, by).where("outcome = 'success'").groupBy(*keys).agg(F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.percentile("latency", 0.5), 6).alias("median_latency"), F.round(F.percentile("latency", 0.95), 6).alias("p95_latency"))
    ratio = F.round(F.col("cache_hits") / F.nullif(F.col("cache_hits") + F.col("requests"), F.lit(0)), 6)
    return counts.join(pairs, keys, "left").withColumn("hit_ratio", ratio)


#: Size of a quantile sketch: ranks are off by about 1.33 in a hundred at 200, by less at more.
SKETCH_K = 800


def latency_sketches(pairs: DataFrame, by: str = "caller_id", width: float = 3600.0) -> DataFrame:
    """(by, session, hour, calls, sketch): KLL sketches of the latencies of successful calls by the hour, to be kept and merged later."""
    hour = F.floor(F.col("asked_ts") / width)
    return pairs.where("outcome = 'success'").groupBy(by, "session", hour.alias("hour")).agg(F.count("*").alias("calls"), F.kll_sketch_agg_double("latency", SKETCH_K).alias("sketch"))


def latency_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95), keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls and approximate quantiles (q50, q95 ..) of merged sketches, by keys, of all without any; a sketch is of bounded size, however many calls it holds."""
    merged = sketches.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    return merged.select(*keys, "calls", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles))
