"""Recorded dialogues of both shapes, replayed, with faults planted in each part."""

import copy
import json

import pytest

from colloquy.operators import intentions as I
from colloquy.sources import readers as R

ORDER = ["category", "color", "budget_max", "size"]


def intention(constraints, priority, old_shape):
    more = {"request": "find me a shirt"} if old_shape else {"gold_search_query": "shirt"}
    return {"constraints": constraints, "priority": priority} | more


def dialogue(old_shape):
    first = {"category": None, "color": "a-red", "budget_max": 30.0, "size": "3x"}
    states = [
        (first, ORDER, {}),
        (first | {"color": None}, ["size", "category", "color", "budget_max"], {"color": {"op": "relax", "old": "a-red", "new": None, "rationale": "r"}, "priority": {"op": "reprioritize", "old": ORDER, "new": ["size", "category", "color", "budget_max"], "rationale": "r"}}),
        (first | {"color": None, "budget_max": 60.0}, ["size", "category", "color", "budget_max"], {"budget_max": {"op": "relax", "old": 30.0, "new": 60.0, "rationale": ""}}),
        # a new wish comes last in the order of wishes and in the priority
        (first | {"color": None, "budget_max": 60.0, "brand": 'with "marks"'}, ["size", "category", "color", "budget_max", "brand"], {"brand": {"op": "add", "old": None, "new": 'with "marks"', "rationale": ""}}),
    ]
    turns = [{"turn_id": i, "user_utterance": "u", "gold_delta": delta, "gold_current_intention": intention(c, p, old_shape)} for i, (c, p, delta) in enumerate(states)]
    task = {"instance_id": "d", "turns": turns}
    return task if old_shape else task | {"initial_intention": intention(first, ORDER, False)}


def audit(spark, path, tasks):
    path.write_text(json.dumps(tasks))
    rows = I.audit_trajectories(R.read_trajectories(spark, str(path))).collect()
    return {(r.instance_id, r.turn_id): (r.constraints_agree, r.order_agree, r.priority_agree, r.olds_agree) for r in rows}


@pytest.mark.parametrize("old_shape", [True, False])
def test_faults_are_found_where_they_are(spark, tmp_path, old_shape):
    whole = dialogue(old_shape)
    assert set(audit(spark, tmp_path / "a.json", [whole]).values()) == {(True,) * 4}
    tasks, want = [], {}

    def planted(name, turn, at, change):
        task = copy.deepcopy(whole) | {"instance_id": name}
        change(task["turns"][turn])
        tasks.append(task)
        want[(name, turn)] = tuple(i != at for i in range(4))

    now = "gold_current_intention"
    planted("value", 2, 0, lambda t: t[now]["constraints"].update(size="4x"))
    planted("order", 1, 1, lambda t: t[now].update(constraints=dict(reversed(t[now]["constraints"].items()))))
    planted("priority", 3, 2, lambda t: t[now].update(priority=t[now]["priority"][::-1]))
    planted("old value", 2, 3, lambda t: t["gold_delta"]["budget_max"].update(old=31.0))
    planted("old order", 1, 3, lambda t: t["gold_delta"]["priority"].update(old=ORDER[::-1]))
    got = audit(spark, tmp_path / "b.json", tasks)
    assert len(got) == 20 and {k: v for k, v in got.items() if not all(v)} == want


def test_turns_without_an_intention_and_dialogues_without_turns(spark, tmp_path):
    task = dialogue(False)
    del task["turns"][2]["gold_current_intention"]
    got = audit(spark, tmp_path / "c.json", [task, {"instance_id": "e", "turns": []}])
    assert got[("d", 2)] == (None, None, None, True) and got[("d", 3)] == (True,) * 4 and len(got) == 4
