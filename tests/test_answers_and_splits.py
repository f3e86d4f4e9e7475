"""Answers that are reused, splits that survive retries, pages of a catalogue for many requests, merged sketches."""

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.operators import candidates as C
from colloquy.operators import logs
from colloquy.plans import bulk
from colloquy.sources import readers as R


class Counting:
    """Answers in capitals, fails on `bad`, and leaves a line for each call in a file."""

    def __init__(self, path):
        self.path = path

    def generate(self, prompt):
        with open(self.path, "a") as f:
            f.write(prompt + "\n")
        if prompt.startswith("bad"):
            raise ValueError(prompt)
        return prompt.upper()


def calls(path):
    return sorted(path.read_text().split()) if path.exists() else []


def test_answers_are_asked_for_once_over_runs(spark, tmp_path):
    said, store = tmp_path / "calls", str(tmp_path / "answers")
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id int, prompt string")
    factory = lambda path=str(said): Counting(path)
    first = {r.id: (r.output, r.error) for r in bulk.bulk_generate(prompts, factory, answers=store, per_write=1).collect()}
    assert first == {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, "no prompt"), 5: (None, "ValueError: bad")}
    assert calls(said) == ["a", "b", "bad"]
    again = {r.id: (r.output, r.error) for r in bulk.bulk_generate(prompts, factory, answers=store).collect()}
    assert again == first and calls(said) == ["a", "b", "bad", "bad"]  # only what failed
    more = bulk.bulk_generate(prompts.unionByName(spark.createDataFrame([(6, "c")], prompts.schema)), factory, answers=store)
    assert {r.id: r.output for r in more.collect()}[6] == "C" and calls(said).count("c") == 1 and calls(said).count("a") == 1
    assert bulk.bulk_generate(prompts.limit(0), factory, answers=store).count() == 0


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_a_prompt_gets_the_latest_answer_before_it(spark, width):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 1), float(rng.randint(0, 30)), i, rng.random() < 0.4) for i in range(300)]
    cache = [(q, k, ts, i, f"r{i}") for q, k, ts, i, given in rows if given]
    asked = [(q, k, ts, i) for q, k, ts, i, given in rows if not given] + [("z", 0, 5.0, 999)]
    hits, misses = logs.cached_responses(spark.createDataFrame(asked, "query string, k int, ts double, event_id long"), spark.createDataFrame(cache, "query string, k int, ts double, event_id long, response string").repartition(3), width=width)
    want = {}
    for q, k, ts, i in asked:
        before = [(t, j, r) for a, b, t, j, r in cache if (a, b) == (q, k) and (t, j) < (ts, i)]
        if before and q is not None:
            want[i] = (max(before)[2], max(before)[0])
    assert {r.event_id: (r.response, r.answered) for r in hits.where("query is not null").collect()} == want
    assert {(r.query, r.k) for r in misses.collect() if r.query} == {(q, k) for q, k, _, i in asked if q and i not in want}


def test_splits_are_found_by_key(spark, tmp_path):
    df = spark.createDataFrame([(i, f"i/{i}") for i in range(1, 31)], "task_index int, instance_id string")
    R.write_split(df, str(tmp_path / "s"), 7)
    assert len(list((tmp_path / "s" / "shards").glob("part-*"))) > 1
    ddl = "task_index int, instance_id string"
    assert [tuple(r) for r in R.read_split(spark, str(tmp_path / "s"), ddl, "09_i_9").collect()] == [(9, "i/9", "09_i_9")]
    assert sorted(r.task_index for r in R.read_split(spark, str(tmp_path / "s"), ddl).collect()) == list(range(1, 31))
    with pytest.raises(ValueError, match="nobody"):
        R.read_split(spark, str(tmp_path / "s"), ddl, "nobody")
    R.write_split(df.limit(0), str(tmp_path / "e"), 7)
    assert R.read_split(spark, str(tmp_path / "e"), ddl).count() == 0


RETRY = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession
from colloquy.sources import readers as R
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def once(frames):
    for i, frame in enumerate(frames):
        yield frame
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")  # after its rows went out
df = spark.createDataFrame([(i, f"i/{i}") for i in range(200)], "task_index int, instance_id string").repartition(4)
plain = R.split_keys
R.split_keys = lambda x: plain(x).mapInPandas(once, plain(x).schema)
R.write_split(df, sys.argv[2], 50)
print(spark.read.json(sys.argv[2] + "/shards").count(), spark.read.parquet(sys.argv[2] + "/index").count())
"""


def test_a_task_that_is_tried_again_leaves_no_double(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", RETRY, root, str(tmp_path / "s")], capture_output=True, text=True, timeout=300)
    assert done.stdout.split()[-2:] == ["200", "200"], done.stderr[-2000:]


def test_pages_of_the_catalogue_for_many_requests(spark):
    cat = spark.createDataFrame([(i, "abc"[i % 3], f"q{i % 5}" if i % 7 else None) for i in range(60)], "row_id long, category string, query string")
    asked = [(r, ["all", "category", "query", "other"][r % 4], [None, "a", "b", "q1", "none"][r % 5], r % 9) for r in range(400)]
    got = C.browse_requests(cat, spark.createDataFrame(asked, "request_id long, mode string, arg string, limit int"))
    rows = cat.collect()
    want = []
    for r, mode, arg, limit in asked:
        fits = [x for x in rows if mode == "all" or (mode in ("category", "query") and arg is not None and x[mode] == arg)]
        want += [(r, i + 1, x.row_id) for i, x in enumerate(fits[:limit])]
    assert sorted((r.request_id, r["rank"], r.row_id) for r in got.collect()) == sorted(want)
    one = spark.createDataFrame([(1, "category", "b", 4)], "request_id long, mode string, arg string, limit int")
    assert [r.row_id for r in C.browse_requests(cat, one).orderBy("rank").collect()] == [r.row_id for r in C.browse(cat, "category", "b", 4).collect()]
    with pytest.raises(Exception, match="more than 1000"):
        C.browse_requests(cat, one.withColumn("limit", F.lit(1001))).collect()


def test_merged_sketches_stay_near_the_exact_quantiles(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 2) for _ in range(30000)]
    pairs = spark.createDataFrame([(i % 3, 1, float(i), v, "success") for i, v in enumerate(values)], "caller_id int, session int, asked_ts double, latency double, outcome string")
    sketches = logs.latency_sketches(pairs, width=1000.0)
    assert sketches.count() == 90
    row = logs.latency_quantiles(sketches).first()
    ranked = sorted(values)
    assert row.calls == 30000
    for q, got in ((0.5, row.q50), (0.95, row.q95)):
        assert ranked[int((q - 0.01) * 30000)] <= got <= ranked[int((q + 0.01) * 30000)]
    assert json.dumps([r.calls for r in logs.latency_quantiles(sketches, keys=("caller_id",)).collect()]) == "[10000, 10000, 10000]"


class Twice:
    def generate(self, prompt):
        return prompt * 2


def test_a_share_reads_its_own_prompts_and_prompts_are_made_once(spark, monkeypatch, tmp_path):
    paths, made = [], spark.sparkContext.accumulator(0)

    def kept(session):
        paths.append(tmp_path / str(len(paths)))
        return str(paths[-1])

    def say(n):
        made.add(1)
        return f"say {n % 50}"

    monkeypatch.setattr(bulk, "scratch_path", kept)
    prompts = spark.range(100).withColumn("prompt", F.udf(say)("id"))
    got = {r.id: r.output for r in bulk.bulk_generate(prompts, Twice, per_write=20).collect()}
    assert got == {n: f"say {n % 50}" * 2 for n in range(100)}
    assert made.value == 100
    folders = [[f for f in p.iterdir() if f.name.startswith("share=")] for p in paths if p.is_dir()]
    dealt = next(f for f in folders if f)
    held = [r.prompt for f in dealt for r in spark.read.parquet(str(f)).collect()]
    assert len(dealt) > 1 and sorted(held) == sorted(f"say {n}" for n in range(50))
