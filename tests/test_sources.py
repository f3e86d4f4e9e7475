import json

import pytest
from pyspark.sql import functions as F

from colloquy.sources import readers as R


def task(i, **more):
    return {"instance_id": f"t/{i}", "turns": [{"turn_id": 0, "user_utterance": f"find {i}", "gold_current_intention": {"request": f"r{i}", "constraints": {"size": None, "budget_max": 30.0}, "priority": ["size"]}}], **more}


def test_trajectories_of_all_shapes(spark, tmp_path):
    for name, data in {"list": [task(1), task(2)], "instances": {"instances": [task(1)], "tasks": [task(2), task(3)]}, "tasks": {"tasks": [task(1), task(2)]}, "bare": task(1)}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    counts = {n: R.read_trajectories(spark, str(tmp_path / f"{n}.json")).count() for n in ("list", "instances", "tasks", "bare")}
    assert counts == {"list": 2, "instances": 1, "tasks": 2, "bare": 1}
    row = R.read_trajectories(spark, str(tmp_path / "bare.json")).first()
    assert row["turns"][0]["gold_current_intention"]["constraints"] == '{"size":null,"budget_max":30.0}'
    with pytest.raises(Exception, match="not a JSON object or array"):
        R.read_tasks(spark, str(tmp_path / "bare.json")).collect()


def test_tasks_of_a_folder_and_of_lines(spark, tmp_path):
    folder = tmp_path / "tasks"
    folder.mkdir()
    (folder / "b.json").write_text(json.dumps(task(2)))
    (folder / "a.json").write_text(json.dumps([task(1), {"turns": [{"user_utterance": "hi"}]}]))
    rows = R.normalize_tasks(R.read_tasks(spark, str(folder))).orderBy("task_index").collect()
    assert [(r["task_index"], r["instance_id"], r["subtype"]) for r in rows] == [(1, "t/1", "shopping"), (2, "webshop_task_002", "shopping"), (3, "t/2", "shopping")]
    assert rows[0]["world_state"]["webshop_instruction_text"] == "r1" and rows[1]["initial_intention"]["gold_search_query"] == "hi"
    (tmp_path / "x.jsonl").write_text(json.dumps(task(1)) + "\n\n" + json.dumps(task(2)) + "\n")
    assert R.read_tasks(spark, str(tmp_path / "x.jsonl")).count() == 2
    assert R.union_task_files(spark, [str(folder / "b.json"), str(folder / "a.json")]).count() == 3


def test_turns_are_nested_again_without_the_request(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([task(1), task(2)]))
    read = R.read_trajectories(spark, str(tmp_path / "a.json"))
    turns = read.select("instance_id", "task_type", "subtype", "world_state", F.explode("turns").alias("turn"))
    R.write_instances(turns, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 2 and "request" not in back.first()["turns"][0]["gold_current_intention"].asDict()
    R.write_split(read, str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["file_key=01_t_1", "file_key=02_t_2"]


def test_prompt_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("", "p", {}), ("s", "q", {"k": "v"})], "source string, prompt string, metadata map<string,string>")
    R.append_prompt_log(rows, str(tmp_path / "log"))
    R.append_prompt_log(rows, str(tmp_path / "log"))
    back = R.read_prompt_log(spark, str(tmp_path / "log"))
    assert back.count() == 4 and {r["source"] for r in back.collect()} == {"unknown", "s"} and back.where("time is null").count() == 0


def test_catalogue_keeps_both_brand_names_apart(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"asin": "A", "Brand": "Big", "pricing": [1.5, 2]}, {"asin": "B", "brand": "small", "Brand": "Big", "Price": "$3"}]))
    assert {r["asin"]: r["brand_name"] for r in R.read_catalog(spark, str(tmp_path / "c.json")).collect()} == {"A": "Big", "B": "small"}


def test_limits_and_selection(spark):
    df = spark.createDataFrame([(i, f"i{i}") for i in range(1, 6)], "task_index int, instance_id string")
    assert R.limit_instances(df, 2).count() == 2 and R.limit_instances(df, None).count() == 5
    for n in (0, 6):
        with pytest.raises(ValueError):
            R.limit_instances(df, n)
    ids = spark.createDataFrame([("i3", 1), ("i1", 2)], "instance_id string, ordinal int")
    assert [r["instance_id"] for r in R.select_instances(df, ids, True).orderBy("ordinal").collect()] == ["i3", "i1"]
    with pytest.raises(ValueError, match="i9"):
        R.select_instances(df, ids.union(spark.createDataFrame([("i9", 3)], ids.schema)))
