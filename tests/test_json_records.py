"""Records of JSON files cut at any byte."""

import json
import random

import pytest

from colloquy.sources import readers as R
from colloquy.sources.json_records import json_lines, json_records


@pytest.fixture(params=[150, 1000, 1 << 27])
def small_ranges(spark, request):
    """Byte ranges of a few bytes, so that records, strings and lists go over their ends."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def some(rng, n):
    texts = ['a "quoted" }, { [x] \\ end\\', "", "é日本 }]", "x" * 90, '"tasks": [', '\\"instances\\": [ {']
    return [{"id": i, "s": rng.choice(texts), "in": [{"tasks": [{"y": rng.choice(texts)}]}, [1, []]], "n": None, "empty": {}} for i in range(n)]


def read(df):
    rows = sorted((r.file.rsplit("/", 1)[-1], r.nr, json.loads(r.json)) for r in df.collect())
    return {f: [x for g, _, x in rows if g == f] for f in {r[0] for r in rows}}, [(f, n) for f, n, _ in rows]


def test_files_of_all_shapes(spark, tmp_path, small_ranges):
    rng = random.Random(small_ranges)
    a = some(rng, 40)
    files = {
        "array": (json.dumps(a), a),
        "pretty": (" \n" + json.dumps(a[:9], indent=3, ensure_ascii=False) + "\n", a[:9]),
        "instances": (json.dumps({"x": {"tasks": [1]}, "tasks": a[:3], "instances": a[3:20], "more": a[20:]}), a[3:20]),
        "tasks": (json.dumps({"instances": 5, "more": a[:4], "tasks": a[5:9], "z": [{"q": 1}]}, indent=1), a[5:9]),
        "none": (json.dumps({"tasks": [], "more": a[:3]}), []),
        "bare": (json.dumps(a[0] | {"in": 2}), [a[0] | {"in": 2}]),
        "bare_newline": (json.dumps({"k": a[:3]}) + "\n\n", [{"k": a[:3]}]),
        "lines": ("\n".join(json.dumps(x) for x in a[:7]), a[:7]),
        "blank": (" \n ", []),
        "nothing": ("[]", []),
    }
    for name, (text, _) in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got, order = read(json_records(spark, str(tmp_path), ("instances", "tasks"), bare=True))
    assert got == {f"{n}.json": rows for n, (_, rows) in files.items() if rows}
    assert order == sorted((f"{n}.json", i) for n, (_, rows) in files.items() for i in range(len(rows)))


def test_lines_of_objects_and_arrays(spark, tmp_path, small_ranges):
    a = some(random.Random(1), 30)
    text = "\n\n".join([json.dumps(a[0]), "  ", json.dumps(a[1:4]), *(json.dumps(x) for x in a[4:])]) + "\n"
    (tmp_path / "x.jsonl").write_text(text)
    got, order = read(json_lines(spark, str(tmp_path / "x.jsonl")))
    assert got == {"x.jsonl": a} and [n for _, n in order] == list(range(30))


@pytest.mark.parametrize("text", ["[1, 2]", '[{"a": 1}, 5]', '{"tasks": [{"a": 1}, "x"]}', '[{"a": 1}, {"b": 2', "hello", "[[{}]]"])
def test_other_content_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="an instance isn't a JSON object|not a JSON object or array"):
        R.read_tasks(spark, str(tmp_path / "x.json")).collect()


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    tasks = [{"instance_id": f"t{i}", "turns": [{"turn_id": 0, "user_utterance": "find } [" * (i % 5)}]} for i in range(50)]
    (tmp_path / "x.json").write_text(json.dumps({"tasks": tasks}))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, tasks)))
    for name in ("x.json", "x.jsonl"):
        rows = sorted(R.read_tasks(spark, str(tmp_path / name)).collect(), key=lambda r: r.task_index)
        assert [(r.task_index, r.instance_id, r.turns[0].user_utterance) for r in rows] == [(i + 1, t["instance_id"], t["turns"][0]["user_utterance"]) for i, t in enumerate(tasks)]
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "x.json"))
    assert pieces.rdd.getNumPartitions() > 10 or small_ranges > 150
