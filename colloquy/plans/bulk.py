"""Bulk model jobs: prompts for whole tables, one client a partition, answers checked and joined.

A client is any object with `generate(prompt) -> str`; its factory is pickled to executors.
The same prompt is asked once, however many rows need it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shifts as S
from ..functions.text import clean_query, clean_request, constraint_key, constraint_value, extract_json, query_from_intention, strip, truthy
from ..operators.candidates import compact_candidate
from ..operators.intentions import fold_priority, normalize_shifts
from ..operators.pages import fallback_actions, validate_actions
from ..operators.rerank import rerank_or_fallback
from ..operators.search import search_candidates
from ..sources.scratch import scratch_path, stored

STRINGS = "array<string>"
ROW = "struct<asin:string,original_rank:string,new_rank:string,product_family_match:string,latest_delta_match:string,constraint_match_level:string,decision:string,matched_constraints:array<string>,missing_or_uncertain_constraints:array<string>,mismatch_reasons:array<string>>"
SHIFT = "struct<intention_changed:boolean,condition:string,category:string,change_category:string,op:string,field:string,old_value:string,value:string,priority_update:array<string>,rationale:string,utterance_plan:struct<style:string,directness:string,mention_old_value:boolean>,gold_search_query:string>"

RERANK_TASK = "Order the candidate items by how well they fit the shopping intention. Look at the product family first, then at the latest change, then at the other constraints. Answer with a JSON object whose list reranked_candidates names at most %d items by asin, best first, each with new_rank, product_family_match, latest_delta_match, constraint_match_level, decision, matched_constraints, missing_or_uncertain_constraints and mismatch_reasons."
SHIFT_TASK = "You are a shopper who has seen these results. Decide how your wishes change. Answer with a JSON object: intention_changed, condition, category, field, old_value, value, priority_update, rationale, utterance_plan."
INSIST = "You are too easily satisfied. Change something now."
QUERY_TASK = "Give a short product search query for this intention. Answer with a JSON object that has gold_search_query."
SAY_TASK = "Say this change of wishes as the shopper would, in one sentence."
ACT_TASK = "Choose the next action on this page. Answer with a JSON object: action_type and action_payload."
INTENTION_TASK = "Turn the instruction into a JSON object with request, constraints (category, budget_max, color, brand, size) and priority."


ANSWER = "digest string, output string, error string"
#: Prompts whose answers are written together; what is lost with an executor is asked again, and no more than these.
PER_WRITE = 100_000
#: Files in which the prompts of a share are kept, so that several tasks read them.
FILES = 16


def answered(spark: SparkSession, path: str) -> DataFrame:
    """The table of answers at path (digest, output, error), empty if there was none."""
    spark.createDataFrame([], ANSWER).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(ANSWER).parquet(path)


def bulk_generate(prompts: DataFrame, client_factory: Callable[[], object], batch_size: int = 64, answers: str | None = None, per_write: int = PER_WRITE) -> DataFrame:
    """prompts (prompt, and others) with output and error; a failed call gives an error, not a failed job.

    Answers are kept by the prompt's digest in a table, at the path `answers` if one is given: what it holds is not
    asked again, in this run or a later one; failed calls are. New prompts are asked in shares of per_write, each
    appended to the table before the next. A null prompt is not asked: its output is null, and its error says so.
    """

    def run(frames):
        client = client_factory()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                outputs, errors = [], []
                for prompt in part["prompt"]:
                    try:
                        outputs.append(client.generate(prompt))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  a model may fail in any way
                        outputs.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"digest": part["digest"], "output": pd.Series(outputs, index=part.index, dtype=object), "error": pd.Series(errors, index=part.index, dtype=object)})

    spark, path = prompts.sparkSession, answers or scratch_path(prompts.sparkSession)
    digest = F.sha2(F.col("prompt"), 256)
    # Prompts are made once, for what is asked and for what is joined with the answers.
    keyed = stored(prompts.withColumn("digest", digest))
    asked = keyed.where(F.col("prompt").isNotNull()).groupBy("digest").agg(F.first("prompt").alias("prompt"))
    known = answered(spark, path).where("error is null").select("digest")
    shares = max(1, -(-keyed.count() // per_write))
    new = asked.join(known, "digest", "left_anti").withColumn("share", F.pmod(F.xxhash64("digest"), F.lit(shares)).cast("int"))
    # A folder a share, so that a share's run reads its own prompts, not all of them.
    at, kinds = scratch_path(spark), new.schema
    if shares > 1:
        new = new.repartition("share", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(FILES)))
    new.write.option("compression", "zstd").partitionBy("share").parquet(at)
    dealt = spark.read.schema(kinds).parquet(at)
    for (i,) in sorted(dealt.select("share").distinct().collect()):
        share = dealt.where(F.col("share") == i).drop("share")
        share.repartition("digest").mapInPandas(run, ANSWER).write.mode("append").parquet(path)
    best = F.max_by(F.struct("output", "error"), F.struct(F.col("error").isNull(), "output", "error"))
    held = answered(spark, path).groupBy("digest").agg(best.alias("best")).select("digest", "best.output", "best.error")
    got = keyed.join(held, "digest", "left").drop("digest")
    return got.withColumn("error", F.when(F.col("prompt").isNull(), "no prompt").otherwise(F.col("error")))


def _prompt(task: Column | str, payload: Column) -> Column:
    return F.concat(F.lit(task) if isinstance(task, str) else task, F.lit("\n\n"), F.to_json(payload))


def bulk_rerank(candidates: DataFrame, intents: DataFrame, client_factory: Callable[[], object], top_k: int = 10) -> DataFrame:
    """Candidates (request_id, place, candidate) in the model's order, or as found where its answer can't be used.

    intents: request_id, intention (JSON without the query), delta (JSON).
    """
    seen = candidates.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", compact_candidate(F.col("candidate"), F.col("place")).alias("c"))), lambda a, b: a["place"] - b["place"]), lambda x: x["c"]).alias("items"))
    asked = seen.join(intents, "request_id").withColumn("prompt", _prompt(RERANK_TASK % top_k, F.struct(F.col("intention").alias("current_shopping_intention"), F.col("delta").alias("gold_delta"), F.col("items").alias("candidate_items"))))
    got = bulk_generate(asked.select("request_id", "prompt"), client_factory)
    answers = stored(got.select("request_id", F.get_json_object(extract_json(F.col("output")), "$.reranked_candidates").alias("list")))
    usable = F.col("list").startswith("[")
    rows = answers.where(usable).select("request_id", F.posexplode(F.from_json("list", f"array<{ROW}>")).alias("pos", "r")).select("request_id", "pos", "r.asin", "r.new_rank", *(f"r.{c}" for c in ("product_family_match", "latest_delta_match", "constraint_match_level", "decision", "matched_constraints", "missing_or_uncertain_constraints", "mismatch_reasons")))
    missing = answers.where(~F.coalesce(usable, F.lit(False))).select("request_id")
    flat = stored(candidates.select("request_id", "place", F.col("candidate.asin").alias("asin"), F.coalesce("candidate.rank", "place").alias("rank")))
    return rerank_or_fallback(rows, flat, top_k, missing)


def bulk_shifts(turns: DataFrame, client_factory: Callable[[], object], seed: int = 0, retry_share: float = 0.5) -> DataFrame:
    """Valid shifts for turns (instance_id, turn_id, timeline and feedback as JSON, and the state of normalize_shifts).

    Answers without a change are asked once more, for a seeded share of the turns.
    """
    asked = turns.withColumn("prompt", _prompt(SHIFT_TASK, F.struct(F.col("timeline").alias("intention_timeline"), F.col("feedback").alias("latest_env_feedback"))))
    parsed = lambda df: df.withColumn("raw", F.from_json(extract_json(F.col("output")), SHIFT)).drop("output", "error")
    first = parsed(bulk_generate(asked, client_factory))
    coin = F.pmod(F.xxhash64(F.lit(seed), "instance_id", "turn_id"), F.lit(1 << 20)) / float(1 << 20)
    again = (F.col("raw.intention_changed") == F.lit(False)) & (coin < retry_share)
    flagged = stored(first.withColumn("again", F.coalesce(again, F.lit(False))))
    second = parsed(bulk_generate(flagged.where("again").drop("raw").withColumn("prompt", F.concat("prompt", F.lit("\n\n" + INSIST))), client_factory))
    both = stored(flagged.where("not again").unionByName(second.select(flagged.columns)))
    r = F.col("raw")
    fields = {"usable": r.isNotNull(), "intention_changed": r["intention_changed"], "condition": r["condition"], "category": F.coalesce(r["category"], r["change_category"]), "op": r["op"], "field": r["field"], "old_value": r["old_value"], "value": r["value"], "rationale": r["rationale"], "update": r["priority_update"], "style": r["utterance_plan"]["style"], "directness": r["utterance_plan"]["directness"], "mention_old_value": r["utterance_plan"]["mention_old_value"], "gold_search_query": r["gold_search_query"]}
    return stored(normalize_shifts(both.withColumns(fields)))


def bulk_queries(intents: DataFrame, client_factory: Callable[[], object]) -> DataFrame:
    """intents (intention JSON, delta JSON or null, and the columns of query_from_intention) with the model's query, else the composed one."""
    payload = F.struct(F.col("intention").alias("updated_gold_intention"), F.col("delta").alias("gold_delta"))
    got = bulk_generate(intents.withColumn("prompt", _prompt(QUERY_TASK, payload)), client_factory)
    model = clean_query(F.get_json_object(extract_json(F.col("output")), "$.gold_search_query"))
    own = query_from_intention(F.col("stored_query"), F.col("category"), F.col("color"), F.col("brand"), F.col("size"), F.col("request"))
    return got.withColumn("gold_search_query", F.coalesce(model, own)).drop("prompt", "output", "error")


def style_of(seed: int) -> Column:
    """One of the styles for a turn, the same on every run and under any partitioning."""
    at = F.pmod(F.xxhash64(F.lit(seed), "instance_id", "turn_id"), F.lit(len(S.STYLES))).cast("int")
    return F.element_at(F.array(*map(F.lit, S.STYLES)), at + 1)


def bulk_utterances(shifts: DataFrame, client_factory: Callable[[], object], seed: int = 0) -> DataFrame:
    """shifts with style and utterance: the model's sentence, else one made from the shift."""
    styled = shifts.withColumn("style", style_of(seed))
    payload = F.struct("op", "field", "old_value", "value", "style")
    got = bulk_generate(styled.withColumn("prompt", _prompt(SAY_TASK, payload)), client_factory)
    own = S.fallback_utterance(F.col("op"), F.col("field"), F.col("value"), F.col("old_value"), F.get(F.col("priority_update"), F.lit(0)), F.col("style"), F.col("utterance_plan.mention_old_value"))
    return got.withColumn("utterance", F.coalesce(truthy(strip(F.col("output"))), own)).drop("prompt", "output", "error")


def bulk_actions(pages: DataFrame, client_factory: Callable[[], object]) -> DataFrame:
    """pages (view and context as JSON, and the page's columns) with next_action: the model's if the page allows it, else a rule's."""
    got = bulk_generate(pages.withColumn("prompt", _prompt(ACT_TASK, F.struct("view", "context", "utterance"))), client_factory)
    raw = extract_json(F.col("output"))
    got = got.withColumns({"action_type": F.get_json_object(raw, "$.action_type"), "payload": F.from_json(F.get_json_object(raw, "$.action_payload"), "map<string,string>")})
    return fallback_actions(validate_actions(got)).drop("prompt", "output", "error", "payload")


def sanitize_intention(raw: Column, request: Column) -> Column:
    """A model's intention (JSON object) with plain fields and values; without a usable one, the request alone."""
    given = F.map_entries(F.from_json(F.get_json_object(raw, "$.constraints"), "map<string,string>"))
    named = F.transform(given, lambda e: F.struct(constraint_key(e["key"]).alias("field"), e["value"].alias("raw")))
    valued = F.transform(named, lambda e: F.struct(e["field"].alias("field"), constraint_value(e["field"], e["raw"]).alias("value")))
    kept = F.coalesce(F.filter(valued, lambda e: (e["field"] != "") & ~e["field"].endswith("_exact") & e["value"].isNotNull()), F.array().cast("array<struct<field:string,value:string>>"))
    fields = F.array_distinct(F.transform(kept, lambda e: e["field"]))
    asked = F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(raw, "$.priority"), STRINGS), F.array().cast(STRINGS)), constraint_key), lambda f: F.array_contains(fields, f))
    said = F.coalesce(truthy(strip(F.get_json_object(raw, "$.request"))), request)
    value = lambda f: F.get(F.filter(kept, lambda e: e["field"] == f), F.lit(0))["value"]
    query = F.coalesce(query_from_intention(F.get_json_object(raw, "$.gold_search_query"), value("category"), value("color"), value("brand"), value("size"), F.lit(None)), said)
    full = F.struct(said.alias("request"), kept.alias("constraints"), F.array_distinct(F.concat(asked, fields)).alias("priority"), query.alias("gold_search_query"))
    plain = F.struct(request.alias("request"), F.array().cast("array<struct<field:string,value:string>>").alias("constraints"), F.array().cast(STRINGS).alias("priority"), request.alias("gold_search_query"))
    return F.when(raw.isNotNull(), full).otherwise(plain)


def bulk_initial_intentions(instructions: DataFrame, client_factory: Callable[[], object] | None = None) -> DataFrame:
    """instructions (instruction) with intention; without a client, or where it fails, the request alone."""
    rows = instructions.withColumn("request", clean_request(F.col("instruction")))
    if client_factory is None:
        return rows.withColumn("intention", F.when(F.col("request") != "", sanitize_intention(F.lit(None).cast("string"), F.col("request"))))
    got = bulk_generate(rows.withColumn("prompt", F.concat(F.lit(INTENTION_TASK + "\n\n"), "request")), client_factory)
    return got.withColumn("intention", F.when(F.col("request") != "", sanitize_intention(extract_json(F.col("output")), F.col("request")))).drop("prompt", "output", "error")


def align_replay(gold: DataFrame, replay: DataFrame) -> DataFrame:
    """Gold turns beside replayed ones, with defaults for style and implication."""
    implied = F.when(F.col("turn_id") == 0, "start_search").otherwise("continue")
    keys = ["instance_id", "turn_id"]
    renamed = replay.select(*keys, *(F.col(c).alias(f"replay_{c}") for c in ("action", "stop_reason", "query", "first_asin")))
    return gold.join(renamed, keys).withColumns({"linguistic_style": F.coalesce(truthy(F.col("linguistic_style")), F.lit("explicit")), "action_implication": F.coalesce(truthy(F.col("action_implication")), implied)})


def replay_agreement(aligned: DataFrame, by: str = "instance_id") -> DataFrame:
    """Per group: turns, and the share in which the replay did as recorded."""
    same = [F.round(F.avg(F.col(c).eqNullSafe(F.col(f"replay_{c}")).cast("int")), 6).alias(f"same_{c}") for c in ("action", "stop_reason", "query", "first_asin")]
    return aligned.groupBy(by).agg(F.count("*").alias("turns"), *same)


def applied(constraints: Column, op: Column, field: Column, value: Column) -> Column:
    """Constraints (field, value) after a shift: a known field keeps its place, a new one comes last."""
    assigns = op.isin(*S.ASSIGNING) & truthy(field).isNotNull()
    made = F.struct(field.alias("field"), value.alias("value"))
    known = F.exists(constraints, lambda c: c["field"] == field)
    changed = F.when(known, F.transform(constraints, lambda c: F.when(c["field"] == field, made).otherwise(c))).otherwise(F.concat(constraints, F.array(made)))
    return F.when(assigns, changed).otherwise(constraints)


def advance_round(dialogues: DataFrame, posted: DataFrame, catalog: DataFrame, client_factory: Callable[[], object], seed: int = 0, top_k: int = 10, max_turns: int = 4) -> DataFrame:
    """All live dialogues one turn on: search, shift and utterance, with the next constraints, priority and query, and whether the dialogue ended.

    dialogues: instance_id, turn_id, query, constraints array<struct<field,value>>, priority,
    request and maybe done. A dialogue ends after max_turns, or where it is done and its wishes don't change. Feed
    next_round() of the result to the next call, at most max_turns + 1 times, and write each round's table before.
    """
    requests = dialogues.select(F.col("instance_id").alias("request_id"), "query", "constraints")
    found = search_candidates(requests, posted, catalog, return_limit=top_k).select(F.col("request_id").alias("instance_id"), "reason", F.col("satisfied"), "violated", F.transform("candidates", lambda c: c["asin"]).alias("found"))
    state = dialogues.join(found, "instance_id").withColumns({"feedback": F.to_json(F.struct("reason", "satisfied", "violated", "found")), "timeline": F.to_json(F.struct("constraints", "priority")), "fields": F.transform("constraints", lambda c: c["field"]), "stored_query": F.col("query")})
    as_map = F.map_from_entries("constraints")
    shifts = bulk_shifts(state.withColumn("wishes", F.col("constraints")).withColumn("constraints", as_map), client_factory, seed)
    said = stored(bulk_utterances(shifts, client_factory, seed))
    start = dialogues.select("instance_id", F.transform("constraints", lambda c: c["field"]).alias("fields"), "priority")
    order = fold_priority(start, said.select("instance_id", F.col("turn_id").cast("int").alias("turn_id"), "op", "field", "priority_update")).select("instance_id", F.col("op").alias("priority_op"), F.col("new").alias("next_priority"))
    done = F.coalesce(F.col("done"), F.lit(False)) if "done" in dialogues.columns else F.lit(False)
    given = dialogues.select("instance_id", "request", F.col("constraints").alias("held"), done.alias("over"))
    out = state.select("instance_id", "turn_id", "query", "reason", "found").join(said.drop("turn_id", "request"), "instance_id").join(given, "instance_id").join(order, "instance_id", "left")
    out = out.withColumn("next_constraints", applied(F.col("held"), F.col("op"), F.col("field"), F.col("value")))
    unchanged = ~F.coalesce(F.col("op").isin(*S.ASSIGNING) & truthy(F.col("field")).isNotNull(), F.lit(False)) & (F.coalesce("priority_op", F.lit("none")) == "none")
    out = stored(out.withColumn("unchanged", unchanged))
    # Changed wishes get a new query from the model, or else keep the old one; others have theirs from the shift.
    value = lambda f: F.get(F.filter("next_constraints", lambda c: c["field"] == f), F.lit(0))["value"].alias(f)
    intention = F.to_json(F.struct("request", F.col("next_constraints").alias("constraints"), F.col("next_priority").alias("priority")))
    intents = out.where(~F.col("unchanged")).select("instance_id", intention.alias("intention"), F.to_json(F.struct("op", "field", "old_value", "value")).alias("delta"), F.col("query").alias("stored_query"), *map(value, ("category", "color", "brand", "size")), "request")
    asked = bulk_queries(intents, client_factory).select("instance_id", F.col("gold_search_query").alias("new_query"))
    ended = (F.col("turn_id") >= max_turns) | (F.col("over") & F.col("unchanged"))
    out = out.join(asked, "instance_id", "left").withColumns({"next_query": F.coalesce("new_query", F.when(F.col("unchanged"), F.col("gold_search_query")), "query"), "ended": ended})
    return out.drop("held", "over", "priority_op", "unchanged", "new_query")


def next_round(rounds: DataFrame) -> DataFrame:
    """The dialogues that go on, as advance_round takes them."""
    return rounds.where(~F.col("ended")).select("instance_id", (F.col("turn_id") + 1).alias("turn_id"), F.col("next_query").alias("query"), F.col("next_constraints").alias("constraints"), F.col("next_priority").alias("priority"), "request")
