"""Intentions over the turns of dialogues: carried forward, folded from shifts, audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shifts as S
from ..functions.text import bound, clean_query, query_from_intention, strip, truthy

STRINGS = "array<string>"


def carry_intention(turns: DataFrame, initial: DataFrame) -> DataFrame:
    """turns (instance_id, turn_id, gold_intention) with intention: their own, else the last before, else the task's."""
    w = W.partitionBy("instance_id").orderBy("turn_id").rowsBetween(W.unboundedPreceding, 0)
    carried = turns.withColumn("carried", F.last("gold_intention", ignorenulls=True).over(w))
    joined = carried.join(initial.select("instance_id", F.col("intention").alias("first_intention")), "instance_id", "left")
    return joined.withColumn("intention", F.coalesce("carried", "first_intention")).drop("carried", "first_intention")


def turn_utterance(utterance: Column, request: Column) -> Column:
    """The recorded utterance if it isn't blank, else the request, else empty."""
    said = F.when(strip(utterance) != "", utterance)
    return F.coalesce(said, truthy(request), F.lit(""))


def assignments(initial: DataFrame, shifts: DataFrame) -> DataFrame:
    """Rows (instance_id, turn_id, field, op, value) of all values that fields get; turn -1 holds the task's own."""
    own = initial.select("instance_id", F.lit(-1).alias("turn_id"), "field", F.lit("initial").alias("op"), "value", F.lit(None).cast("string").alias("rationale"))
    made = shifts.where(F.col("op").isin(*S.ASSIGNING) & truthy(F.col("field")).isNotNull())
    return own.unionByName(made.select("instance_id", "turn_id", "field", "op", "value", "rationale"))


def shift_deltas(initial: DataFrame, shifts: DataFrame) -> DataFrame:
    """(instance_id, turn_id, field, op, old, new, rationale) of each assigning shift; old is the state's value, not the shift's claim."""
    w = W.partitionBy("instance_id", "field").orderBy("turn_id")
    rows = assignments(initial, shifts).withColumn("old", F.lag(F.struct("value")).over(w)["value"])
    return rows.where("op <> 'initial'").select("instance_id", "turn_id", "field", "op", "old", F.col("value").alias("new"), "rationale")


def fold_intentions(initial: DataFrame, shifts: DataFrame) -> DataFrame:
    """(instance_id, turn_id, field, value) of every field known after each turn's shift; a null value is a wish given up, not one never made."""
    turns = shifts.select("instance_id", "turn_id").distinct()
    given = assignments(initial, shifts)
    fields = given.select("instance_id", "field").distinct()
    grid = turns.join(fields, "instance_id").join(given.select("instance_id", "turn_id", "field", F.struct("value").alias("set")), ["instance_id", "turn_id", "field"], "left")
    before = given.where("op = 'initial'").select("instance_id", "turn_id", "field", F.struct("value").alias("set"))
    w = W.partitionBy("instance_id", "field").orderBy("turn_id").rowsBetween(W.unboundedPreceding, 0)
    held = grid.unionByName(before).withColumn("held", F.last("set", ignorenulls=True).over(w))
    return held.where((F.col("turn_id") >= 0) & F.col("held").isNotNull()).select("instance_id", "turn_id", "field", F.col("held.value").alias("value"))


def fold_priority(initial: DataFrame, shifts: DataFrame) -> DataFrame:
    """(instance_id, turn_id, op, old, new) of each turn's priority after its shift; the fold stays inside one dialogue's row.

    initial has instance_id, fields and priority; shifts have op, field and priority_update.
    """
    none = F.array().cast(STRINGS)
    step = F.struct("turn_id", "op", "field", F.coalesce("priority_update", none).alias("update"))
    lists = shifts.groupBy("instance_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows = lists.join(initial, "instance_id")
    start = F.struct(F.col("fields").alias("fields"), complete(F.col("priority"), F.col("fields")).alias("priority"), F.array().cast("array<struct<turn_id:int,op:string,old:array<string>,new:array<string>>>").alias("out"))

    def fold(state: Column, s: Column) -> Column:
        assigns = s["op"].isin(*S.ASSIGNING) & truthy(s["field"]).isNotNull()
        fields = F.when(assigns, F.array_distinct(F.concat(state["fields"], F.array(s["field"])))).otherwise(state["fields"])
        known = lambda f: F.array_distinct(F.concat(state["priority"], f))
        asked = lambda f: F.when((s["op"] != "none") & (F.size(s["update"]) > 0), bound(known(f), lambda k: S.priority_update(s["update"], k)))

        def moved(b: Column) -> Column:
            changed = b["asked"].isNotNull() & (b["asked"] != state["priority"])
            after = complete(F.when(changed, b["asked"]).otherwise(state["priority"]), b["fields"])
            return bound(F.struct(changed.alias("changed"), after.alias("after")), lambda m: made(b, m))

        def made(b: Column, m: Column) -> Column:
            op = F.when(m["changed"], "reprioritize").otherwise("none")
            entry = F.struct(s["turn_id"].cast("int").alias("turn_id"), op.alias("op"), state["priority"].alias("old"), m["after"].alias("new"))
            return F.struct(b["fields"].alias("fields"), m["after"].alias("priority"), F.concat(state["out"], F.array(entry)).alias("out"))

        return bound(fields, lambda f: bound(F.struct(f.alias("fields"), asked(f).alias("asked")), moved))

    folded = rows.select("instance_id", F.aggregate("steps", start, fold)["out"].alias("out"))
    return folded.select("instance_id", F.explode("out").alias("o")).select("instance_id", "o.*")


def complete(priority: Column, fields: Column) -> Column:
    """The priority's known fields, each once, then the other fields in their own order."""
    none = F.array().cast(STRINGS)
    held = F.coalesce(priority, none)
    known = bound(F.array_distinct(F.concat(fields, held)), lambda all_: F.transform(held, lambda p: S.match_field(p, all_)))
    return F.array_distinct(F.concat(F.filter(known, lambda k: k.isNotNull()), fields))


def intention_timeline(turns: DataFrame, n: int = 4) -> DataFrame:
    """turns (turn_id, intention, delta) with timeline: the n turns before, then the current one, flagged."""
    w = W.partitionBy("instance_id").orderBy("turn_id").rowsBetween(-n, -1)
    entry = lambda turn, current: F.struct(turn.alias("turn_id"), F.lit(current).alias("is_current"), F.col("intention").alias("gold_intention"), F.col("delta").alias("gold_delta"))
    earlier = F.collect_list(entry(F.col("turn_id").cast("string"), False)).over(w)
    return turns.withColumn("timeline", F.concat(earlier, F.array(entry(F.lit("current"), True))))


def utterance_context(turns: DataFrame, n: int = 8) -> DataFrame:
    """turns (role, text, current) with context: the last n user utterances that aren't blank, the current one added unless it is the last."""
    said = F.when((F.lower(strip(F.col("role"))) == "user") & (strip(F.col("text")) != ""), strip(F.col("text")))
    before = W.partitionBy("instance_id").orderBy("turn_id").rowsBetween(W.unboundedPreceding, 0)
    # Turns are numbered by the utterances so far, so a range of n numbers holds the last n utterances and no more.
    out = turns.withColumn("said so far", said).withColumn("nth", F.count("said so far").over(before))
    last = W.partitionBy("instance_id").orderBy("nth").rangeBetween(-(n - 1), 0)
    out = out.withColumn("seen", F.collect_list("said so far").over(last))
    now = strip(F.col("current"))
    added = F.when((now != "") & ~F.coalesce(F.try_element_at("seen", F.lit(-1)), F.lit("")).eqNullSafe(now), F.concat("seen", F.array(now))).otherwise(F.col("seen"))
    out = out.withColumn("all", added)
    return out.withColumn("context", F.slice("all", F.greatest(F.lit(1), F.size("all") - F.lit(n - 1)), F.lit(n))).drop("said so far", "nth", "seen", "all")


def truncate_dialogues(turns: DataFrame, max_turns: int, empty_delta_ends: bool = False) -> DataFrame:
    """Turns 0 to max_turns, up to the first that is done (and, if so asked, has an empty delta)."""
    done = F.coalesce("done", F.lit(False))
    ends = done & F.coalesce("delta_empty", F.lit(True)) if empty_delta_ends else done
    before = F.max(ends).over(W.partitionBy("instance_id").orderBy("turn_id").rowsBetween(W.unboundedPreceding, -1))
    return turns.where(F.col("turn_id") <= max_turns).withColumn("ended", F.coalesce(before, F.lit(False))).where("not ended").drop("ended")


def validate_deltas(initial: DataFrame, deltas: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded constraints (instance_id, turn_id, field, value) beside those that the deltas give, with agrees."""
    made = fold_intentions(initial, deltas).select("instance_id", "turn_id", "field", F.struct(F.col("value")).alias("made"))
    held = recorded.select("instance_id", "turn_id", "field", F.struct(F.col("value")).alias("recorded"))
    both = made.join(held, ["instance_id", "turn_id", "field"], "full")
    return both.withColumn("agrees", F.col("made").eqNullSafe(F.col("recorded")))


ENTRIES = "array<struct<key:string,value:string>>"


def audit_trajectories(instances: DataFrame) -> DataFrame:
    """(instance_id, turn_id, constraints_agree, order_agree, priority_agree, olds_agree) for each turn of recorded dialogues.

    instances: instance_id, initial_intention (may be null) and turns with turn_id, gold_delta and gold_current_intention,
    as read_trajectories gives them. The deltas are replayed turn by turn from the initial intention, or where there
    is none from the first turn's own. Each turn's recorded intention is compared with the replayed one: its wishes
    and their values, the order of the wishes, the priority; olds_agree tells whether the delta's old values are
    those of the turn before. A fault of a record doesn't reach later turns; a turn without an intention has nulls.
    """
    none, empty = F.array().cast(STRINGS), F.array().cast(ENTRIES)
    wishes = lambda c: F.coalesce(F.map_entries(F.from_json(c["constraints"], "map<string,string>")).cast(ENTRIES), empty)
    ranks = lambda c: F.coalesce(c["priority"], none)
    delta = lambda t: F.coalesce(F.transform(F.map_entries(t["gold_delta"]), lambda e: F.struct(e["key"].alias("key"), e["value"]["old"].alias("old"), e["value"]["new"].alias("new"))), F.array().cast("array<struct<key:string,old:string,new:string>>"))
    now = lambda t: t["gold_current_intention"]
    step = lambda t: F.struct(t["turn_id"].alias("turn_id"), delta(t).alias("delta"), now(t).isNotNull().alias("known"), wishes(now(t)).alias("constraints"), ranks(now(t)).alias("priority"))
    rows = instances.select("instance_id", "initial_intention", F.array_sort(F.transform("turns", step)).alias("steps")).where(F.size("steps") > 0)
    given, first = F.col("initial_intention"), F.get(F.col("steps"), F.lit(0))
    rows = rows.withColumn("begin", F.when(given.isNotNull(), F.struct(wishes(given).alias("constraints"), ranks(given).alias("priority"))).otherwise(F.struct(first["constraints"].alias("constraints"), first["priority"].alias("priority"))))
    names = lambda c: F.transform(c, lambda e: e["key"])
    out_type = "array<struct<turn_id:int,constraints_agree:boolean,order_agree:boolean,priority_agree:boolean,olds_agree:boolean>>"
    state_type = f"struct<constraints:{ENTRIES},priority:{STRINGS},out:{out_type}>"
    start = F.struct(F.col("begin.constraints").alias("constraints"), complete(F.col("begin.priority"), names(F.col("begin.constraints"))).alias("priority"), F.array().cast(out_type).alias("out")).cast(state_type)

    def assigned(held: Column, e: Column) -> Column:
        entry = F.struct(e["key"].alias("key"), e["new"].alias("value"))
        known = F.array_contains(names(held), e["key"])
        changed = F.transform(held, lambda x: F.when(x["key"] == e["key"], entry).otherwise(x))
        return F.when(known, changed).otherwise(F.concat(held, F.array(entry))).cast(ENTRIES)

    def replay(state: Column, t: Column) -> Column:
        # Without an initial intention the first turn's own is what the replay begins with.
        own = (F.size(state["out"]) == 0) & given.isNull()
        made = F.when(own, F.filter(t["delta"], lambda e: F.lit(False))).otherwise(t["delta"])
        fields = F.filter(made, lambda e: e["key"] != "priority")
        order = F.get(F.filter(made, lambda e: e["key"] == "priority"), F.lit(0))

        def judged(b: Column) -> Column:
            same = lambda x, y: F.array_sort(x) == F.array_sort(y)
            value = lambda k: F.get(F.filter(state["constraints"], lambda x: x["key"] == k), F.lit(0))["value"]
            olds = F.forall(b["fields"], lambda e: e["old"].eqNullSafe(value(e["key"]))) & (b["order"].isNull() | F.from_json(b["order"]["old"], STRINGS).eqNullSafe(state["priority"]))
            known = lambda c: F.when(t["known"], c)
            entry = F.struct(
                t["turn_id"].cast("int").alias("turn_id"),
                known(same(b["after"], t["constraints"])).alias("constraints_agree"),
                known(names(b["after"]) == names(t["constraints"])).alias("order_agree"),
                known(b["priority"] == t["priority"]).alias("priority_agree"),
                olds.alias("olds_agree"),
            )
            return F.struct(b["after"].alias("constraints"), b["priority"].alias("priority"), F.concat(state["out"], F.array(entry)).alias("out")).cast(state_type)

        def ranked(b: Column) -> Column:
            new = F.coalesce(F.from_json(b["order"]["new"], STRINGS), state["priority"])
            return bound(F.struct(b["fields"].alias("fields"), b["order"].alias("order"), b["after"].alias("after"), complete(new, names(b["after"])).alias("priority")), judged)

        return bound(F.struct(fields.alias("fields"), order.alias("order"), F.aggregate(fields, state["constraints"], assigned).alias("after")), ranked)

    folded = rows.select("instance_id", F.aggregate("steps", start, replay)["out"].alias("out"))
    return folded.select("instance_id", F.explode("out").alias("o")).select("instance_id", "o.*")


def instance_rollup(turns: DataFrame) -> DataFrame:
    """Per dialogue: turns, first and last intention, and the utterances in order."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "utterance"))), lambda t: t["utterance"])
    return turns.groupBy("instance_id").agg(F.count("*").alias("turns"), F.min_by("intention", "turn_id").alias("first_intention"), F.max_by("intention", "turn_id").alias("last_intention"), said.alias("utterances"))


def shift_distribution(shifts: DataFrame) -> DataFrame:
    """Shifts by op, condition and field, with all subtotals; level tells which are summed over."""
    return shifts.cube("op", "condition", "field").agg(F.count("*").alias("shifts"), F.grouping_id().alias("level"))


def normalize_shifts(outputs: DataFrame) -> DataFrame:
    """Raw model shifts beside their intention as valid shifts; what can't be used becomes op none with invalid_llm_output.

    outputs: raw fields (usable, intention_changed, condition, category, op, field, old_value,
    value, rationale, update, style, directness, mention_old_value, gold_search_query) and the
    state (constraints map<string,string>, fields and priority arrays, request, stored_query). Where there is a column
    kinds (map<string,string>, by variant_kind of the wishes' values), values take the type of the old ones by it, so that
    a text that looks like a number stays a text; else types are guessed from texts.
    """
    none = F.array().cast(STRINGS)
    df = outputs.withColumns({"known": F.array_distinct(F.concat("fields", F.coalesce("priority", none))), "order": complete(F.col("priority"), F.col("fields"))})
    df = df.withColumns({"cond": S.alias_condition(F.col("condition")), "cat0": S.alias_category(F.col("category")), "op0": S.alias_category(F.col("op"))})
    df = df.withColumns({"op1": F.when(F.col("op0") == "none", F.col("cat0")).otherwise(F.col("op0")), "cat1": F.when(F.col("cat0") == "none", F.col("op0")).otherwise(F.col("cat0"))})
    df = df.withColumns({"changed": F.coalesce(F.col("intention_changed"), (F.col("cat1") != "none") | (F.col("op1") != "none")), "matched": S.match_field(F.col("field"), F.col("known")), "made": S.field_name(F.col("field"))})
    df = df.withColumn("fresh", F.col("matched").isNull() & F.col("made").isNotNull())
    forced = lambda c: F.when(F.col("fresh") & ~F.col(c).isin("add", "reprioritize"), "add").otherwise(F.col(c))
    df = df.withColumns({"name": F.coalesce("matched", "made"), "op2": forced("op1"), "cat2": forced("cat1"), "why": F.coalesce(truthy(strip(F.col("rationale"))), F.lit("llm_decision")), "asked": S.priority_update(F.col("update"), F.array_distinct(F.concat("order", "known")))})
    guess = S.infer_category(F.col("asked"), F.col("rationale"), F.col("name"), F.col("old_value"), F.col("value"))
    df = df.withColumn("cat3", F.when(F.col("cat2") == "none", guess).otherwise(F.col("cat2")))
    df = df.withColumn("op3", F.when(F.col("op2") == "none", F.col("cat3")).otherwise(F.col("op2")))
    df = df.withColumn("cond3", F.when(F.col("cond") == "none", S.infer_condition(F.col("op3"), F.col("rationale"))).otherwise(F.col("cond")))
    is_new = ~F.array_contains(F.col("fields"), F.col("name"))
    df = df.withColumn("is_new", F.coalesce(is_new, F.lit(True)))
    to_add = F.col("is_new") & (F.col("op3") != "reprioritize")
    df = df.withColumns({"op4": F.when(to_add, "add").otherwise(F.col("op3")), "cat4": F.when(to_add, "add").otherwise(F.col("cat3")), "now": F.col("constraints")[F.col("name")]})
    kind = F.col("kinds")[F.col("name")] if "kinds" in outputs.columns else None
    old = F.when(~F.col("is_new"), F.coalesce(S.coerce_value(F.col("name"), F.col("old_value"), F.col("now"), kind), F.col("now")))
    df = df.withColumn("old4", old)
    new = S.coerce_value(F.col("name"), F.col("value"), F.col("old4"), kind)
    loose = S.relax_value(F.col("name"), F.col("old4"))
    df = df.withColumn("new3", F.when(new.isNull() & (F.col("op4") == "relax"), loose).otherwise(new))
    stiff = (F.col("op4") == "relax") & F.col("old4").isNotNull() & ~F.coalesce(S.is_relaxation(F.col("name"), F.col("old4"), F.col("new3")), F.lit(True))
    df = df.withColumn("new4", F.when(stiff, loose).otherwise(F.col("new3")))
    update = F.coalesce(F.col("asked"), F.when(F.col("name").isNotNull(), S.move_to_front(F.col("name"), F.col("order"))))
    reorder = F.col("op4") == "reprioritize"
    invalid = (
        ~F.coalesce("usable", F.lit(False))
        | (F.col("changed") & (F.col("cat3") == "none"))
        | (F.col("changed") & reorder & update.isNull())
        | (F.col("changed") & ~reorder & (F.col("name").isNull() | ((F.col("op4") == "add") & F.col("old4").isNotNull()) | (F.col("op4").isin("add", "override", "scope_correction") & F.col("new3").isNull())))
    )
    df = df.withColumns({"invalid": invalid, "reorder": reorder, "update4": F.when(reorder, update).otherwise(F.col("asked"))})
    live = F.col("changed") & ~F.col("invalid")
    kept = lambda c: F.when(live, F.col(c))
    query = F.coalesce(clean_query(F.col("gold_search_query")), F.when(~F.col("changed") | F.col("reorder"), query_from_intention(F.col("stored_query"), F.col("constraints")["category"], F.col("constraints")["color"], F.col("constraints")["brand"], F.col("constraints")["size"], F.col("request"))))
    keys = [c for c in ("instance_id", "turn_id", "id") if c in outputs.columns]
    return df.select(
        *keys,
        F.when(live, F.col("op4")).otherwise("none").alias("op"),
        live.alias("intention_changed"),
        F.when(live, F.col("cond3")).otherwise("none").alias("condition"),
        F.when(live, F.col("cat4")).otherwise("none").alias("change_category"),
        kept("name").alias("field"),
        F.when(live & ~F.col("reorder"), F.col("old4")).alias("old_value"),
        F.when(live & ~F.col("reorder"), F.col("new4")).alias("value"),
        F.when(F.col("invalid"), "invalid_llm_output").otherwise(F.col("why")).alias("rationale"),
        F.when(~F.col("invalid"), F.col("update4")).alias("priority_update"),
        F.when(~F.col("invalid"), S.utterance_plan(F.col("style"), F.col("directness"), F.col("mention_old_value"))).alias("utterance_plan"),
        F.when(~F.col("invalid"), query).alias("gold_search_query"),
    )
