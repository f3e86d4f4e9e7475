"""Step traces: changes of state, progress, streaks, stalls and stop reasons, by window functions.

All of them share one partitioning, (instance_id, turn_id) by step_index, so Spark sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import asin_key, norm_text, text_of, truthy
from .candidates import returned_items

TURN = ("instance_id", "turn_id")
MAX_STEPS = 12
STUCK_AFTER = 2
# How far a page is on the way to an item.
PAGE_RANK = {"unknown": 0, "search": 0, "results": 1, "item": 2}
SEARCHING = ("search", "refine")


def ordered():
    return W.partitionBy(*TURN).orderBy("step_index")


def _sorted_map(c: Column, key=norm_text) -> Column:
    entries = F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>")))
    return F.array_sort(F.transform(entries, lambda e: F.struct(key(e["key"]).alias("key"), norm_text(e["value"]).alias("value"))))


def state_signature() -> Column:
    """What makes two states equal: page, id, options, the first five visible ids, title, price and satisfied wishes."""
    visible = F.transform(F.slice(F.coalesce("visible_asins", F.array().cast("array<string>")), 1, 5), asin_key)
    satisfied = F.array_sort(F.transform(F.coalesce("satisfied", F.array().cast("array<string>")), norm_text))
    asin = F.coalesce(truthy(F.col("selected_asin")), F.col("result_asin"))
    return F.struct(text_of(F.col("page_type")).alias("page"), text_of(asin).alias("asin"), _sorted_map(F.col("selected_options")).alias("options"), F.filter(visible, lambda v: v != "").alias("visible"), norm_text(F.col("title")).alias("title"), F.col("price").alias("price"), satisfied.alias("satisfied"))


def state_changed(steps: DataFrame) -> DataFrame:
    """steps with state_changed: the signature differs from that of the step before, or there is none before."""
    w, out = ordered(), steps.withColumn("state", state_signature())
    return out.withColumn("state_changed", ~F.col("state").eqNullSafe(F.lag("state").over(w)))


def page_rank(c: Column) -> Column:
    out = F.lit(0)
    for page, rank in PAGE_RANK.items():
        out = F.when(norm_text(c) == page, rank).otherwise(out)
    return out


def made_progress(steps: DataFrame) -> DataFrame:
    """steps with made_progress: a page further on, another item, more or other options, more satisfied, other visible items, another title; the first step always."""
    none = F.array().cast("array<string>")
    visible = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("visible_asins", none), asin_key), lambda v: v != "")))
    seen = F.struct(page_rank(F.col("page_type")).alias("page"), F.col("selected_asin").alias("asin"), F.array_sort(F.map_entries(F.coalesce("selected_options", F.create_map().cast("map<string,string>")))).alias("options"), F.size(F.coalesce("satisfied", none)).alias("satisfied"), visible.alias("visible"), norm_text(F.col("title")).alias("title"))
    out = steps.withColumn("now", seen).withColumn("before", F.lag("now").over(ordered()))
    now, before = F.col("now"), F.col("before")
    moved = (
        (now["page"] > before["page"])
        | (truthy(now["asin"]).isNotNull() & ~now["asin"].eqNullSafe(before["asin"]))
        | ~now["options"].eqNullSafe(before["options"])
        | (now["satisfied"] > before["satisfied"])
        | ((F.size(now["visible"]) > 0) & (now["visible"] != before["visible"]))
        | ((now["title"] != "") & (now["title"] != before["title"]))
    )
    return out.withColumn("made_progress", F.when(before.isNull(), True).otherwise(F.coalesce(moved, F.lit(False)))).drop("now", "before")


def action_signature() -> Column:
    return F.struct(text_of(F.col("action_type")).alias("type"), _sorted_map(F.col("action_payload"), text_of).alias("payload"))


def repeat_streak(steps: DataFrame) -> DataFrame:
    """steps with repeat_streak: length of the run of equal actions up to here."""
    w, out = ordered(), steps.withColumn("act", action_signature())
    out = out.withColumn("run", F.sum(F.when(F.col("act").eqNullSafe(F.lag("act").over(w)), 0).otherwise(1)).over(w))
    return out.withColumn("repeat_streak", F.row_number().over(W.partitionBy(*TURN, "run").orderBy("step_index"))).drop("act", "run")


def stagnant_steps(steps: DataFrame) -> DataFrame:
    """steps (made_progress) with stagnant_steps: steps since the last progress."""
    w = ordered()
    out = steps.withColumn("run", F.sum(F.col("made_progress").cast("int")).over(w))
    return out.withColumn("stagnant_steps", F.sum((~F.col("made_progress")).cast("int")).over(W.partitionBy(*TURN, "run").orderBy("step_index"))).drop("run")


def stop_reason(max_steps: int = MAX_STEPS) -> Column:
    """The first rule that holds for a step (status, env_done, all_satisfied, ready, repeat_streak, stagnant_steps)."""
    return (
        F.when(F.col("action_type") == "buy", "virtual_buy")
        .when(F.col("status").isNull(), "no_feedback")
        .when(F.col("status") == "error", "error")
        .when(F.col("env_done"), "env_done")
        .when(F.col("all_satisfied"), "rollout_options_satisfied")
        .when(F.col("ready"), "candidate_ready")
        .when((F.col("repeat_streak") >= STUCK_AFTER) | (F.col("stagnant_steps") >= STUCK_AFTER), "stuck")
        .when(F.col("step_index") >= max_steps, "step_budget")
    )


def stop_reasons(steps: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """steps with stop_reason, up to the first step of each turn that has one."""
    out = steps.withColumn("stop_reason", stop_reason(max_steps))
    first = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("step_index"))).over(W.partitionBy(*TURN))
    return out.withColumn("last", first).where(F.col("last").isNull() | (F.col("step_index") <= F.col("last"))).drop("last")


def turn_rollup(steps: DataFrame) -> DataFrame:
    """Per turn: steps, searches and their queries in order, the last action, and why it stopped."""
    searching = F.col("action_type").isin(*SEARCHING)
    query = F.coalesce(F.col("action_payload")["query"], F.lit(""))
    queries = F.transform(F.array_sort(F.collect_list(F.when(searching, F.struct(F.col("step_index").alias("i"), query.alias("q"))))), lambda x: x["q"])
    return steps.groupBy(*TURN).agg(F.count("*").alias("num_internal_steps"), F.count_if(searching).alias("num_search_actions"), queries.alias("search_queries"), F.max_by("action_type", "step_index").alias("last_action"), F.coalesce(F.max_by("stop_reason", "step_index"), F.lit("step_budget")).alias("stop_reason"))


def step_context(steps: DataFrame, n: int = 6) -> DataFrame:
    """steps with context: the n steps before in their turn, with three items each, clipped."""
    items = F.transform(F.slice(F.coalesce("candidates", F.array().cast(steps.schema["candidates"].dataType)), 1, 3), lambda c: F.struct(c["asin"].alias("asin"), F.substring(F.trim(text_of(c["title"])), 1, 120).alias("title"), c["price"].alias("price")))
    payload = F.map_filter(F.transform_values("action_payload", lambda _, v: F.substring(F.trim(text_of(v)), 1, 200)), lambda _, v: v != "")
    entry = F.struct(F.col("step_index").alias("internal_step"), F.trim(text_of(F.col("action_type"))).alias("action_type"), payload.alias("action_payload"), F.trim(text_of(F.col("page_type"))).alias("page_type"), F.trim(text_of(F.col("selected_asin"))).alias("selected_asin"), items.alias("returned_items"))
    return steps.withColumn("context", F.collect_list(entry).over(ordered().rowsBetween(-n, -1)))


def history_items(steps: DataFrame, limit: int = 10) -> DataFrame:
    """steps (candidates, visible_items) with returned_items."""
    shown = F.when(F.size(F.coalesce("candidates", F.array().cast(steps.schema["candidates"].dataType))) > 0, F.col("candidates")).otherwise(F.col("visible_items"))
    return steps.withColumn("returned_items", returned_items(shown, limit))


def direct_trace(searches: DataFrame) -> DataFrame:
    """A search-only turn (query, candidates) as its one step: stopped by direct_search, with progress if it found anything."""
    query = text_of(F.col("query"))
    found = F.size(F.coalesce("candidates", F.array().cast(searches.schema["candidates"].dataType))) > 0
    entry = F.struct(F.lit(1).alias("step_index"), F.lit("search").alias("action_type"), F.create_map(F.lit("query"), query).alias("action_payload"), F.lit(True).alias("state_changed"), found.alias("made_progress"), F.lit("direct_search").alias("stop_reason"))
    return searches.select(*TURN, F.array(entry).alias("rollout_trace"), F.lit(1).alias("num_internal_steps"), (query != "").cast("int").alias("num_search_actions"), F.when(query != "", F.array(query)).otherwise(F.array().cast("array<string>")).alias("search_queries"), F.lit("direct_search").alias("stop_reason"))
