"""The folds and log rates on streams.

The two folds need rows in order, which a stream doesn't give: they hold rows back until the watermark has
passed them, by event-time timers, fold what is complete in its order, and give a key's state up once it has
been idle for a horizon of event time. Their state is kept in RocksDB, which transformWithStateInPandas needs.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.shifts import ASSIGNING
from ..operators.steps import STUCK_AFTER

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 60 * 60 * 1000


def use_rocksdb(spark: SparkSession) -> str | None:
    """Set the session's state store for queries that start from now on to RocksDB; the setting before, or None."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    return before


def _matching(raw: str | None, known: list[str]) -> str | None:
    """The first known field that equals raw but for case and spaces."""
    name = (raw or "").strip().replace(" ", "_").lower()
    return next((k for k in known if name and k.lower() == name), None)


@lru_cache(maxsize=1 << 14)
def _complete(priority: tuple[str, ...], fields: tuple[str, ...]) -> tuple[str, ...]:
    """The priority's known fields, each once, then the other fields; dialogues meet the same ones again and again."""
    known = list(dict.fromkeys([*fields, *priority]))
    held = [m for m in (_matching(p, known) for p in priority) if m is not None]
    return tuple(dict.fromkeys([*held, *fields]))


def folded(constraints: dict, priority: list[str], op: str, field: str | None, value: str | None, update: list[str]) -> tuple[dict, list[str], bool]:
    """Constraints and priority after a shift, and whether the shift reordered; the row form of fold_intentions and fold_priority."""
    if op in ASSIGNING and field:
        constraints = constraints | {field: value}
    fields = list(constraints)
    known = list(dict.fromkeys([*priority, *fields]))
    asked = None
    if op != "none" and update:
        named = [m for m in (_matching(r, known) for r in update) if m is not None]
        asked = list(dict.fromkeys([*named, *known]))
    moved = asked is not None and asked != priority
    return constraints, list(_complete(tuple(asked if moved else priority), tuple(fields))), moved


#: Groups in which the keys of a fold share their state, unless a caller asks for more.
GROUPS = 1024
#: Rows of a source for each group, as groups_for deals them.
ROWS_A_GROUP = 16_384
# Times in keys are written to the microsecond, so that keys come back as they were.
KEY_FORM = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def groups_for(rows: int) -> int:
    """Groups for a source of so many rows: more where GROUPS would hold more than ROWS_A_GROUP rows each."""
    return max(GROUPS, -(-rows // ROWS_A_GROUP))


class _InOrder(StatefulProcessor):
    """Rows of a key held until the watermark has passed their time, then given to `fold` in order.

    Calls to the store and to Python cost far more than what they carry, so keys share groups by their hash, and a
    group has one value of state: for each key what fold keeps, the time of the last folded row, and the rows that
    wait. One timer is set for the first thing that is due in the group: a row that waits, or the end of a key's state.
    """

    def __init__(self, columns: list[str], horizon_ms: int):
        self.columns, self.horizon_ms = columns, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "kept string")

    def first(self) -> dict:
        """The state of a key that has none."""
        return {}

    def fold(self, who: str, state: dict, nth: int, row: dict) -> tuple[dict, tuple | None]:
        """The state after a row, and what it gives."""
        raise NotImplementedError

    def left(self, who: str, state: dict) -> tuple | None:
        """What a key gives when its state goes."""
        return None

    def _kept(self) -> dict:
        held = self.held.get()
        return json.loads(held[0]) if held is not None else {"due": None, "keys": {}}

    def _keep(self, kept: dict) -> None:
        """Keep the state and set the timer; without keys the state goes."""
        if not kept["keys"]:
            self.held.clear()
            return
        kept["due"] = min(own["waiting"][0][0] if own["waiting"] else own["last"] + self.horizon_ms for own in kept["keys"].values())
        self.held.update((json.dumps(kept, ensure_ascii=False),))
        self.handle.registerTimer(kept["due"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for frame in rows:
            frame = frame[frame["nth"].notna() & frame["at"].notna()]
            for who, at, nth, row in zip(*(frame[c].tolist() for c in ("who", "at", "nth", "row"))):
                new.setdefault(who, []).append([int(at), int(nth), row])
        if new:
            kept = self._kept()
            for who, more in new.items():
                own = kept["keys"].setdefault(who, {"state": self.first(), "last": None, "waiting": []})
                own["waiting"] = sorted(own["waiting"] + more)
            self._keep(kept)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, kept = timerValues.getCurrentWatermarkInMs(), self._kept()
        # A timer of a time that has been dealt with since, or of a state that went.
        if kept["due"] is None or kept["due"] > now:
            return
        out, over = [], []
        for who, own in kept["keys"].items():
            waiting = own["waiting"]
            n = bisect_right(waiting, now, key=lambda r: r[0])
            for at, nth, row in waiting[:n]:
                own["state"], made = self.fold(who, own["state"], nth, json.loads(row))
                own["last"] = at
                if made is not None:
                    out.append(made)
            own["waiting"] = waiting[n:]
            if own["last"] is not None and not own["waiting"] and own["last"] + self.horizon_ms <= now:
                made = self.left(who, own["state"])
                if made is not None:
                    out.append(made)
                over.append(who)
        for who in over:
            del kept["keys"][who]
        self._keep(kept)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame, key: list[str], groups: int) -> DataFrame:
    """rows with who (JSON of the key) and kin, the number of the group that the key is in."""
    kin = F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int")
    return rows.withColumns({"who": F.to_json(F.struct(*key), KEY_FORM), "kin": kin})


def _in_order(rows: DataFrame, key: list[str], order: str, values: list[str], late: str, groups: int) -> object:
    """rows (time) by group, as _InOrder reads them: who, at (ms), nth and row (JSON of the values)."""
    packed = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    made = _grouped(rows.withWatermark("time", late), key, groups).select("kin", "time", "who", F.unix_millis("time").alias("at"), F.col(order).cast("long").alias("nth"), packed.alias("row"))
    return made.groupBy("kin")


def _named_again(folded: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """What a fold gave, with the columns of the key for who."""
    kind = StructType([rows.schema[c] for c in key])
    return folded.withColumn("who", F.from_json("who", kind, KEY_FORM)).select("who.*", *(c for c in folded.columns if c != "who"))


class _Intentions(_InOrder):
    def first(self) -> dict:
        return {"constraints": {}, "priority": []}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        kept = self._kept()
        for r in initialState.to_dict("records"):
            kept["keys"][r["who"]] = {"state": json.loads(r["state"]), "last": int(r["last"]), "waiting": []}
        self._keep(kept)

    def fold(self, who, state, nth, row):
        old = state["priority"]
        constraints, priority, moved = folded(state["constraints"], old, row["op"], row["field"], row["value"], row["priority_update"] or [])
        made = (who, nth, json.dumps(constraints, ensure_ascii=False), "reprioritize" if moved else "none", old, priority)
        return {"constraints": constraints, "priority": priority}, made


def stream_intentions(shifts: DataFrame, initial: DataFrame | None = None, late: str = "10 minutes", horizon_ms: int = DAY_MS, groups: int = GROUPS) -> DataFrame:
    """The state after each shift (instance_id, turn_id, time, op, field, value, priority_update) of a dialogue, as the batch folds give it.

    instance_id, turn_id, constraints (JSON in the fields' order), op (reprioritize or none), old and new (the priority
    before and after). A shift comes out once the watermark, `late` behind the newest time, has passed it; until then
    earlier ones may still come in. Shifts are folded by time, then turn. initial is a batch table (instance_id,
    fields, values and priority arrays, since: a timestamp), the state that dialogues begin with. A
    dialogue without a shift for horizon_ms of event time gives up its state. Rows without a time or turn only
    move the watermark. Dialogues share state in so many groups, which stays as it is over runs from one checkpoint; a
    group is read and written whole, so groups_for gives more of them for more rows.
    """
    key, names = ["instance_id"], ["who", "turn_id", "constraints", "op", "old", "new"]
    begin = None
    if initial is not None:
        pairs = F.map_from_arrays("fields", "values")
        order = initial.select("instance_id", "since", pairs.alias("constraints"), _column_complete().alias("priority"))
        state = F.to_json(F.struct("constraints", "priority"), {"ignoreNullFields": "false"})
        cast = order.withColumn("instance_id", F.col("instance_id").cast(shifts.schema["instance_id"].dataType))
        begin = _grouped(cast, key, groups).select("kin", "who", state.alias("state"), F.unix_millis("since").alias("last")).groupBy("kin")
    rows = _in_order(shifts, key, "turn_id", ["op", "field", "value", "priority_update"], late, groups)
    made = rows.transformWithStateInPandas(_Intentions(names, horizon_ms), "who string, turn_id long, constraints string, op string, old array<string>, new array<string>", "Append", "EventTime", begin)
    return _named_again(made, shifts, key)


def _column_complete():
    from ..operators.intentions import complete

    return complete(F.col("priority"), F.col("fields"))


class _StopMonitor(_InOrder):
    def __init__(self, columns, horizon_ms, max_steps: int):
        super().__init__(columns, horizon_ms)
        self.max_steps = max_steps

    def first(self) -> dict:
        return {"last": None, "streak": 0, "stagnant": 0, "step": None, "done": False}

    def fold(self, who, state, nth, row):
        if state["done"]:
            return state, None
        streak = state["streak"] + 1 if state["streak"] and row["signature"] == state["last"] else 1
        stagnant = 0 if row["progress"] else state["stagnant"] + 1
        rules = (
            (row["action_type"] == "buy", "virtual_buy"),
            (row["status"] is None, "no_feedback"),
            (row["status"] == "error", "error"),
            (row["env_done"], "env_done"),
            (row["all_satisfied"], "rollout_options_satisfied"),
            (row["ready"], "candidate_ready"),
            (streak >= STUCK_AFTER or stagnant >= STUCK_AFTER, "stuck"),
            (nth >= self.max_steps, "step_budget"),
        )
        reason = next((name for holds, name in rules if holds), None)
        after = {"last": row["signature"], "streak": streak, "stagnant": stagnant, "step": nth, "done": reason is not None}
        return after, None if reason is None else (who, nth, reason)

    def left(self, who, state):
        return None if state["done"] or state["step"] is None else (who, state["step"], "step_budget")


def stream_stop_monitor(steps: DataFrame, max_steps: int, late: str = "10 minutes", idle_ms: int = DAY_MS, groups: int = GROUPS) -> DataFrame:
    """(instance_id, turn_id, step_index, stop_reason): where each turn stops, once a turn.

    steps: instance_id, turn_id, step_index, time, action_type, status, env_done, all_satisfied, ready, signature,
    progress. The first rule that holds decides, in the order of stop_reason. Steps are looked at in their order, by time
    and index, once the watermark has passed them. A turn without a stop that is idle for idle_ms of event time ends as
    turn_rollup ends it, by step_budget at its last step, and its state goes; the state of stopped turns goes then too.
    Turns share state in groups, as the dialogues of stream_intentions do.
    """
    key = ["instance_id", "turn_id"]
    values = ["action_type", "status", "env_done", "all_satisfied", "ready", "signature", "progress"]
    rows = _in_order(steps, key, "step_index", values, late, groups)
    monitor = _StopMonitor(["who", "step_index", "stop_reason"], idle_ms, max_steps)
    made = rows.transformWithStateInPandas(monitor, "who string, step_index long, stop_reason string", "Append", "EventTime")
    return _named_again(made, steps, key)


def stream_token_rate(log: DataFrame, width: str = "1 minute", over: str | None = None, late: str = "10 minutes", ids: tuple[str, ...] = ()) -> DataFrame:
    """Requests, fallbacks and tokens per window of event time (start, end); in append mode a window comes out once it is closed.

    With `over`, sums over windows of that length that slide by `width` are made of the tumbling ones, through
    window_time. With ids, which name a log line, lines that come twice count once, and each line that comes after the
    watermark is dropped for itself, so that late_rows tells how many there were.
    """
    log = log.withWatermark("time", late)
    if ids:
        log = log.dropDuplicatesWithinWatermark(list(ids))
    counted = log.groupBy(F.window("time", width).alias("w")).agg(F.count_if(F.col("event") == "request").alias("requests"), F.count_if(F.col("event") == "fallback").alias("fallbacks"), F.sum("estimated_input_tokens").alias("tokens"))
    if over:
        sliding = F.window(F.window_time("w"), over, width).alias("v")
        counted = counted.groupBy(sliding).agg(*(F.sum(c).alias(c) for c in ("requests", "fallbacks", "tokens"))).withColumnRenamed("v", "w")
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "fallbacks", "tokens")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, in the batches whose progress Spark still holds.

    An operator that merges rows before its state, such as an aggregation, counts what it merged; rows are exact where
    dropDuplicatesWithinWatermark comes first.
    """
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def stream_call_latency(log: DataFrame, within: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests with their outcome within a bound; those without one come out once the watermark has passed."""
    asked = log.where("event = 'request'").select(F.col("call_id").alias("call_id"), F.col("time").alias("asked")).withWatermark("asked", late)
    done = log.where("event in ('success', 'fallback')").select(F.col("call_id").alias("done_id"), F.col("time").alias("done"), F.col("event").alias("outcome")).withWatermark("done", late)
    bound = F.expr(f"call_id = done_id and done >= asked and done <= asked + interval {within}")
    return asked.join(done, bound, "left_outer").select("call_id", "asked", "done", "outcome")


def stream_sessions(log: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", by: str = "caller_id") -> DataFrame:
    """Bursts of calls, split where a caller is idle."""
    counted = log.withWatermark("time", late).groupBy(by, F.session_window("time", gap).alias("w")).agg(F.count("*").alias("calls"))
    return counted.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def stream_dedup_calls(log: DataFrame, late: str = "10 minutes", keys: tuple[str, ...] = ("query", "k")) -> DataFrame:
    """The first call of each (query, k) inside the horizon."""
    return log.withWatermark("time", late).dropDuplicatesWithinWatermark(list(keys))
