"""Stream folds against the batch ones: rows dealt over micro-batches out of order, late rows, state that leaves."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy import queries as Q
from colloquy.operators import intentions as I
from colloquy.operators import steps
from colloquy.streaming import streams

START = datetime(2024, 1, 1)
HOUR_MS = 3600 * 1000


def at(hours):
    return START + timedelta(hours=hours)


def dealt(spark, rows, ddl, jitter=5, each=24, beat=5000):
    """Rows (hours first) in slices of `each` hours, each up to `jitter` hours late, and a row that only moves the watermark."""
    rng = random.Random(3)
    out = [(at(r[0]), *r[1:], int((r[0] + rng.random() * jitter) // each)) for r in rows]
    out.append((at(beat), *[None] * (len(rows[0]) - 1), 10**6))
    return spark.createDataFrame(out, f"time timestamp, {ddl}, slice int").repartition(3)


@pytest.fixture()
def states(monkeypatch):
    """Rows of state that each run of a drained stream leaves."""
    left = []
    plain = Q.drained

    def drained(spark, source, job):
        return plain(spark, source, job, watch=lambda q: left.append([s["numRowsTotal"] for s in q.recentProgress[-1]["stateOperators"]]))

    monkeypatch.setattr(Q, "drained", drained)
    return left


def test_intentions_equal_the_batch_folds(spark, states):
    rng = random.Random(8)
    names = ["Color", "size", "budget_max", "brand x", "low"]
    shifts = []
    for who in range(7):
        hour = rng.random()
        for turn in range(12):
            op = rng.choice(["add", "relax", "override", "reprioritize", "none", "scope_correction"])
            field = rng.choice([*names, None, ""])
            update = rng.choice([[], None, [rng.choice(names).upper()], ["nowhere", "brand X", "LOW"], ["size", "size", "color"]])
            shifts.append((hour, who, turn, op, field, rng.choice(["1", "é", None]), update))
            hour += rng.random() * 9
    initial = [(who, ["low", "Size"], ["0", None], ["size"] if who % 2 else []) for who in range(7)]
    first = spark.createDataFrame(initial, "instance_id long, fields array<string>, values array<string>, priority array<string>")
    rows = dealt(spark, shifts, "instance_id long, turn_id int, op string, field string, value string, priority_update array<string>")
    begin = first.withColumn("since", F.lit(START))
    got = Q.drained(spark, rows, lambda s: streams.stream_intentions(s, begin, "8 hours", 300 * HOUR_MS)).collect()
    assert len(got) == len(shifts)
    made = rows.where("turn_id is not null")
    order = {(r.instance_id, r.turn_id): (r.op, r.old, r.new) for r in I.fold_priority(first, made).collect()}
    assert {(r.instance_id, r.turn_id): (r.op, r.old, r.new) for r in got} == order
    own = first.select("instance_id", F.explode(F.arrays_zip("fields", "values")).alias("z")).select("instance_id", F.col("z.fields").alias("field"), F.col("z.values").alias("value"))
    held = {}
    for r in I.fold_intentions(own, made.withColumn("rationale", F.lit(""))).collect():
        held.setdefault((r.instance_id, r.turn_id), {})[r.field] = r.value
    import json

    assert {(r.instance_id, r.turn_id): json.loads(r.constraints) for r in got} == held
    # dialogues have state while they go on, and none once the horizon is over
    assert states[0] == [7] and states[-1] == [0]


def test_a_smaller_turn_of_a_later_batch_is_folded_first(spark, states):
    rows = [(1, 0, "add", "color", "red", 0), (3, 2, "add", "color", "blue", 0), (2, 1, "override", "color", "red", 1), (900, None, None, None, None, 2)]
    df = spark.createDataFrame([(1 if t is not None else None, at(h), t, op, f, v, s) for h, t, op, f, v, s in rows], "instance_id long, time timestamp, turn_id int, op string, field string, value string, slice int").withColumn("priority_update", F.array().cast("array<string>"))
    got = Q.drained(spark, df, lambda s: streams.stream_intentions(s, late="3 hours")).collect()
    assert [(r.turn_id, r.constraints) for r in sorted(got, key=lambda r: r.turn_id)] == [(0, '{"color": "red"}'), (1, '{"color": "red"}'), (2, '{"color": "blue"}')]


def test_stop_monitor_knows_all_reasons(spark, states):
    rng = random.Random(6)
    made = []
    plans = {"virtual_buy": {"action_type": "buy"}, "no_feedback": {"status": None}, "error": {"status": "error"}, "env_done": {"env_done": True}, "rollout_options_satisfied": {"all_satisfied": True}, "candidate_ready": {"ready": True}, "step_budget": {}, None: {}}
    for who, (reason, change) in enumerate(plans.items()):
        for turn in ("a", "b"):
            hour, n = rng.random() * 20, 12 if reason == "step_budget" else 3 if reason is None else 4
            for i in range(1, n + 1):
                step = {"action_type": "search", "status": "observed", "env_done": False, "all_satisfied": False, "ready": False, "signature": f"s{i}", "progress": True}
                if turn == "b" and i == 2 and reason != "virtual_buy":
                    step["signature"] = "s1"  # stuck, unless something comes before it
                if i == (2 if turn == "b" else 3) and reason != "step_budget":
                    step |= change
                made.append((hour, who, turn, i, *step.values()))
                hour += rng.random() * 2
    ddl = "instance_id long, turn_id string, step_index long, action_type string, status string, env_done boolean, all_satisfied boolean, ready boolean, signature string, progress boolean"
    rows = dealt(spark, made, ddl)
    got = {(r.instance_id, r.turn_id): (r.step_index, r.stop_reason) for r in Q.drained(spark, rows, lambda s: streams.stream_stop_monitor(s, 12, "8 hours", 100 * HOUR_MS)).collect()}
    known = rows.where("step_index is not null").withColumn("action_payload", F.create_map(F.lit("s"), "signature")).withColumn("made_progress", F.col("progress"))
    batch = steps.turn_rollup(steps.stop_reasons(steps.stagnant_steps(steps.repeat_streak(known)), 12)).collect()
    assert got == {(r.instance_id, r.turn_id): (r.num_internal_steps, r.stop_reason) for r in batch}
    assert {reason for _, reason in got.values()} == {*(p for p in plans if p), "stuck"}
    assert states[-1] == [0]


def test_token_rate_closes_windows_and_counts_late_rows(spark):
    rows = [(h / 60, i, "request" if i % 3 else "fallback", i) for i, h in enumerate([0, 1, 2, 3, 4, 10, 11, 70, 71, 72])]
    late = [(at(5 / 60), 100 + i, "request", 7, 2) for i in range(3)]
    df = spark.createDataFrame([(at(h), i, e, n, 0 if h < 1 else 1) for h, i, e, n in rows] + late + [(at(1 / 60), 1, "request", 1, 0)], "time timestamp, event_id long, event string, estimated_input_tokens long, slice int")
    dropped = []
    got = Q.drained(spark, df, lambda s: streams.stream_token_rate(s, "5 minutes", late="10 minutes", ids=("event_id",)), watch=lambda q: dropped.append(streams.late_rows(q))).collect()
    # windows up to an hour are closed, the last one isn't, and the late rows change none of them
    assert sorted((int((r.start - START).total_seconds() // 60), r.requests, r.fallbacks, r.tokens) for r in got) == [(0, 3, 2, 10), (10, 1, 1, 11)]
    assert sum(dropped) == 3


def test_dialogues_share_state_in_groups(spark, states):
    ids = ['a "b"', "é\n", "", None, *map(str, range(96))]
    shifts = [(i % 7 + 10 * turn, who, turn, "override", f"f{(i + turn) % 3}", f"{who}/{turn}", [f"F{turn}"]) for i, who in enumerate(ids) for turn in range(5)]
    rows = dealt(spark, shifts, "instance_id string, turn_id int, op string, field string, value string, priority_update array<string>")
    got = Q.drained(spark, rows, lambda s: streams.stream_intentions(s, None, "8 hours", 300 * HOUR_MS, groups=3)).collect()
    want = {}
    for i, who in enumerate(ids):
        held = {}
        for turn in range(5):
            held[f"f{(i + turn) % 3}"] = f"{who}/{turn}" if who is not None else "None/%d" % turn
            want[who, turn] = dict(held)
    import json

    assert {(r.instance_id, r.turn_id): json.loads(r.constraints) for r in got} == want and len(got) == len(want)
    # a row of state for a group, not for a dialogue: each costs several calls between Python and the store
    assert 0 < max(n for (n,) in states) <= 3 and states[-1] == [0]


def test_turns_share_state_in_groups(spark, states):
    made = [(who % 5 + hour, who, at(24 * day), hour + 1, "search", "observed", False, False, False, f"s{hour}", True) for who in range(60) for day in range(2) for hour in range(1 + who % 3)]
    rows = dealt(spark, made, "instance_id long, turn_id timestamp, step_index long, action_type string, status string, env_done boolean, all_satisfied boolean, ready boolean, signature string, progress boolean")
    got = Q.drained(spark, rows, lambda s: streams.stream_stop_monitor(s, 3, "8 hours", 100 * HOUR_MS, groups=2)).collect()
    assert sorted((r.instance_id, r.turn_id, r.step_index, r.stop_reason) for r in got) == sorted((who, at(24 * day), 1 + who % 3, "step_budget") for who in range(60) for day in range(2))
    assert 0 < max(n for (n,) in states) <= 2 and states[-1] == [0]


def test_groups_follow_the_rows():
    assert streams.groups_for(0) == streams.groups_for(10**6) == streams.GROUPS
    assert streams.groups_for(10**9) * streams.ROWS_A_GROUP >= 10**9
