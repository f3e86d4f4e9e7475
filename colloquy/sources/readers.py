"""Readers and writers of trajectories, tasks, catalogues and logs.

Schemas are given, never inferred, and open JSON stays text. Every reader also takes Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import truthy
from .json_records import json_lines, json_records

CANDIDATE = "struct<asin:string,rank:int,title:string,price:double,pricing:array<double>,query:string,category:string,product_category:string,description:string,bullet_points:array<string>,attributes:array<string>,options:map<string,array<string>>,brand:string,color:string>"
INTENTION = "struct<request:string,constraints:string,priority:array<string>,gold_search_query:string>"
ACTION = "struct<action_type:string,action_payload:map<string,string>>"
STEP = f"struct<step_index:int,action:{ACTION},page_type:string,selected_asin:string,selected_options:map<string,string>,state_changed:boolean,made_progress:boolean,stop_reason:string>"
TURN = (
    f"struct<turn_id:int,user_utterance:string,agent_action:{ACTION},"
    f"env_feedback:struct<status:string,feedback_type:string,page_type:string,requested_constraints:string,candidate_items:array<{CANDIDATE}>,selected_candidate:{CANDIDATE},rerank_info:string>,"
    "trigger_evidence:struct<trigger_type:string,source:string,details:struct<change_category:string,op:string,field:string,rationale:string>>,"
    "shift_condition:struct<type:string,reason:string,source:string,details:struct<intention_changed:boolean,condition:string,change_category:string,op:string,field:string,old_value:string,value:string,priority_update:array<string>>>,"
    "gold_delta:map<string,struct<op:string,old:string,new:string,rationale:string>>,"
    f"gold_current_intention:{INTENTION},linguistic_style:string,action_implication:string,num_internal_steps:int,num_rollout_search_actions:int,rollout_search_queries:array<string>,stop_reason:string,rollout_trace:array<{STEP}>>"
)
INSTANCE = f"instance_id string, task_type string, subtype string, world_state map<string,string>, initial_intention {INTENTION}, turns array<{TURN}>"
CATALOG = "asin string, Title string, name string, pricing array<double>, Price string, BulletPoints array<string>, Attributes array<string>, options map<string,array<string>>, Description string, full_description string, category string, product_category string, query string, brand_name string, Rating string, Reviews array<struct<score:string,summary:string,body:string>>, MainImage string, option_to_image map<string,string>, instruction_text string, instruction_attributes array<string>"
CALL_LOG = "ts double, event string, request_count bigint, cache_hit_count bigint, query string, k bigint, rerank_count bigint, estimated_input_tokens bigint, error string, caller array<string>"
PROMPT_LOG = "timestamp string, source string, prompt string, metadata map<string,string>"


def _instance_struct() -> str:
    return "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in _split(INSTANCE)) + ">"


def _split(ddl: str) -> list[str]:
    """Fields of a schema text, split at the commas outside of angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def _instances(records: DataFrame) -> DataFrame:
    """(file, nr, record) of JSON texts, each an instance."""
    bad = F.raise_error(F.concat(F.lit("an instance isn't a JSON object: "), F.col("file"))).cast(_instance_struct())
    parsed = F.when(F.col("json").isNull() | F.startswith(F.col("json"), F.lit("{")), F.from_json("json", _instance_struct())).otherwise(bad)
    return records.select("file", "nr", parsed.alias("record"))


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Instances of a file: an object, an array, or the lists `instances` or, if there are none, `tasks`. Large files are read by many tasks."""
    return _indexed(_instances(json_records(spark, path, ("instances", "tasks"), bare=True)))


def _indexed(rows: DataFrame) -> DataFrame:
    """rows (file, nr, record) with one index over all files: files are ranked by name, so only each file's count meets in one place."""
    per_file = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per_file.withColumn("before", before).drop("n")
    return rows.join(starts, "file").withColumn("task_index", (F.col("nr") + F.col("before") + 1).cast("int")).select("task_index", "record.*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a folder of .json files in order of their names, of a .jsonl file, or of a file with an array or the list `tasks`; a bare object is no task file."""
    if path.endswith(".jsonl"):
        return _indexed(_instances(json_lines(spark, path)))
    if path.endswith(".json"):
        return _indexed(_instances(json_records(spark, path, ("tasks",))))
    return _indexed(_instances(json_records(spark, f"{path.rstrip('/')}/*.json", ("tasks",), bare=True)))


def union_task_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All tasks of several files, as they come, in the order of the files' names."""
    return _indexed(_instances(json_records(spark, sorted(paths), ("tasks",), bare=True)))


def normalize_tasks(df: DataFrame) -> DataFrame:
    """Tasks with their initial intention (own, else of the first turn, else from its utterance) and defaults filled in; a task without any is an error."""
    first = F.get(F.col("turns"), F.lit(0))
    said = truthy(first["user_utterance"])
    from_text = F.when(said.isNotNull(), F.struct(said.alias("request"), F.lit("{}").alias("constraints"), F.array().cast("array<string>").alias("priority"), said.alias("gold_search_query")))
    missing = F.raise_error(F.concat(F.lit("no initial intention in task "), F.col("task_index").cast("string"))).cast(INTENTION)
    out = df.withColumn("initial_intention", F.coalesce("initial_intention", first["gold_current_intention"], from_text, missing))
    request = truthy(F.trim(F.col("initial_intention.request")))
    world = F.coalesce("world_state", F.create_map(F.lit("domain"), F.lit("webshop")))
    text = F.when(request.isNotNull() & ~F.map_contains_key(world, "webshop_instruction_text"), F.map_concat(world, F.create_map(F.lit("webshop_instruction_text"), request))).otherwise(world)
    return out.withColumns({"world_state": text, "instance_id": F.coalesce(truthy(F.col("instance_id")), F.format_string("webshop_task_%03d", "task_index")), "task_type": F.coalesce(truthy(F.col("task_type")), F.lit("transaction")), "subtype": F.coalesce(truthy(F.col("subtype")), F.lit("shopping"))})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products as a typed table, from Parquet or JSON lines or arrays; `brand` and `Brand` are told apart."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    rows = json_records(spark, path, bare=True)
    fields = [f.strip() for f in _split(CATALOG)]
    typed = F.from_json("json", "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields) + ">")
    brand = F.coalesce(truthy(F.get_json_object("json", "$.brand")), truthy(F.get_json_object("json", "$.Brand")))
    price = F.get_json_object("json", "$.Price")
    names = [f.split(" ")[0] for f in fields]
    columns = {n: F.col(f"p.{n}") for n in names} | {"brand_name": brand, "Price": price}
    return rows.withColumn("p", typed).select(*(columns[n].alias(n) for n in names))


def read_rerank_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A call log of JSON lines, with the time as a timestamp; streaming reads files as they come."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CALL_LOG).json(path).withColumn("time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))


def read_prompt_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PROMPT_LOG).json(path).withColumn("time", F.to_timestamp("timestamp"))


def append_prompt_log(df: DataFrame, path: str) -> None:
    """Append (source, prompt, metadata): an empty source is unknown, empty metadata is left out; each task writes its own file."""
    rows = df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.coalesce(truthy(F.col("source")), F.lit("unknown")).alias("source"), F.col("prompt").cast("string").alias("prompt"), F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"))
    rows.write.mode("append").json(path)


def public_turn(c: Column) -> Column:
    """A turn whose gold intention doesn't show the request."""
    return c.withField("gold_current_intention", F.when(c["gold_current_intention"].isNotNull(), c["gold_current_intention"].dropFields("request")))


def nested_instances(turns: DataFrame) -> DataFrame:
    """Turns (instance_id, task_type, subtype, world_state, turn) nested under their instance, in order."""
    numbered = F.struct(F.col("turn.turn_id").alias("i"), F.to_json(public_turn(F.col("turn"))).alias("json"))
    rows = turns.groupBy("instance_id").agg(F.any_value("task_type").alias("task_type"), F.any_value("subtype").alias("subtype"), F.any_value("world_state").alias("world_state"), F.array_sort(F.collect_list(numbered)).alias("numbered"))
    kind = TURN.replace("request:string,constraints", "constraints")
    return rows.select("instance_id", "task_type", "subtype", "world_state", F.transform("numbered", lambda t: F.from_json(t["json"], kind)).alias("turns"))


def write_instances(turns: DataFrame, path: str) -> None:
    nested_instances(turns).write.mode("overwrite").json(path)


def split_keys(instances: DataFrame) -> DataFrame:
    """instances (task_index) with file_key: the position and the id with other characters as underscores."""
    safe = F.regexp_replace(F.coalesce("instance_id", F.format_string("task_%03d", "task_index")), r"[^\p{L}\p{N}_.-]", "_")
    return instances.withColumn("file_key", F.format_string("%02d_%s", "task_index", safe))


def write_split(instances: DataFrame, path: str, per_shard: int | None = None) -> None:
    """One output for each instance: a folder of its own, or, for many instances, a JSON line in one of the shards of about per_shard lines by task_index, with an index of where each is.

    Shards are written by Spark's committed writer, so what a lost task wrote doesn't stay. The index (file_key, shard)
    is made of what was committed.
    """
    spark, rows = instances.sparkSession, split_keys(instances)
    if per_shard is None:
        rows.write.mode("overwrite").partitionBy("file_key").json(path)
        return
    shards = max(1, -(-instances.count() // per_shard))
    rows.repartitionByRange(shards, "task_index").sortWithinPartitions("task_index").write.mode("overwrite").json(f"{path}/shards")
    found = spark.read.schema("file_key string").json(f"{path}/shards")
    found.select("file_key", F.col("_metadata.file_name").alias("shard")).repartitionByRange(shards, "file_key").sortWithinPartitions("file_key").write.mode("overwrite").parquet(f"{path}/index")


def read_split(spark: SparkSession, path: str, schema: str, file_key: str | None = None) -> DataFrame:
    """The instances of a split in shards, with file_key; of one file_key only its shards are read."""
    if file_key is None:
        return spark.read.schema(f"{schema}, file_key string").json(f"{path}/shards")
    shards = [r[0] for r in spark.read.parquet(f"{path}/index").where(F.col("file_key") == file_key).select("shard").distinct().collect()]
    if not shards:
        raise ValueError(f"no instance {file_key} in the split")
    return spark.read.schema(f"{schema}, file_key string").json([f"{path}/shards/{x}" for x in shards]).where(F.col("file_key") == file_key)


def public_feedback(c: Column) -> Column:
    """What of a feedback struct others may see; a null feedback stays null."""
    made = F.struct(c["status"].alias("status"), F.lit("candidate_items").alias("feedback_type"), c["page_type"].alias("page_type"), F.coalesce(c["candidate_items"], F.array().cast(f"array<{CANDIDATE}>")).alias("candidate_items"), c["selected_candidate"].alias("selected_candidate"), c["rerank_info"].alias("rerank_info"))
    return F.when(c.isNotNull(), made)


def missing_ids(ids: DataFrame, df: DataFrame, key: str = "instance_id") -> DataFrame:
    return ids.select(key).distinct().join(df.select(key), key, "left_anti")


def select_instances(df: DataFrame, ids: DataFrame, keep_order: bool = False, key: str = "instance_id", order: str = "task_index") -> DataFrame:
    """Rows of the ids asked for (with ordinal): in table order, or, if asked, in the order of the request with the last row of an id. A missing id is an error."""
    gone = missing_ids(ids, df, key).limit(20).collect()
    if gone:
        raise ValueError(f"ids that aren't there: {', '.join(str(r[0]) for r in gone)}")
    if not keep_order:
        return df.join(ids.select(key).distinct(), key, "left_semi")
    last = df.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("nth = 1").drop("nth")
    return last.join(ids.select(key, "ordinal"), key)


def limit_instances(df: DataFrame, n: int | None, order: str = "task_index", explicit_ids: bool = False) -> DataFrame:
    """The first n rows in table order; fewer than asked for is an error, unless the ids were named."""
    if n is None:
        return df
    if n < 1:
        raise ValueError("at least one instance must be asked for")
    first = df.orderBy(order).limit(n)
    if not explicit_ids and first.count() < n:
        raise ValueError(f"{n} instances were asked for, which is more than there are")
    return first


def restore_order(df: DataFrame, order: str = "task_index") -> DataFrame:
    return df.orderBy(order)
