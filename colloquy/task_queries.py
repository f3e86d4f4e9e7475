"""Further registered queries: files of tasks, catalogues and logs written and read back, pages, and bulk model jobs.

Customers are tasks and their orders the turns; what stands in for a model answers from its prompt alone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import candidates as C
from .operators import intentions as I
from .operators import pages, search
from .operators.steps import history_items
from .plans import bulk
from .queries import (
    CATALOG_SEARCH_SQL,
    CATALOG_SQL,
    LOG_SQL,
    NORMAL_SQL,
    RANKED_SQL,
    SHIFTS_SQL,
    WISHES_SQL,
    call_log,
    catalog,
    order_shifts,
    query,
    ranked_lines,
    raw_shifts,
    table,
    wishes,
)
from .sources import readers
from .sources.scratch import scratch_path

#: Instances of a file that holds one JSON document.
FILE_INSTANCES = 100


# Files ------------------------------------------------------------------------------------


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """(key, json): customers with orders as tasks; some lack an id and a type, an intention, or any but an utterance."""
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    order = F.col("o_orderkey").cast("string")
    wish = F.struct(
        F.concat(F.lit("want "), order).alias("request"),
        F.create_map(F.lit("budget_max"), F.floor("o_totalprice")).alias("constraints"),
        F.array(F.lit("budget_max")).alias("priority"),
    )
    turn = F.struct(
        nth.alias("turn_id"),
        F.concat(F.lit("say "), order).alias("user_utterance"),
        F.when(F.col("o_custkey") % 21 != 0, wish).alias("gold_current_intention"),
    )
    said = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), turn.alias("turn"))
    rows = said.groupBy("key").agg(F.array_sort(F.collect_list("turn"), lambda a, b: a["turn_id"] - b["turn_id"]).alias("turns"))
    key = F.col("key").cast("string")
    own = F.struct(F.concat(F.lit("own "), key).alias("request"), F.create_map(F.lit("size"), key).alias("constraints"))
    named = F.col("key") % 5 != 0
    task = F.struct(
        F.when(named, F.concat(F.lit("c/"), key)).alias("instance_id"),
        F.when(named, "explore").alias("task_type"),
        F.when(F.col("key") % 2 == 0, F.create_map(F.lit("domain"), F.lit("shop"))).alias("world_state"),
        F.when(F.col("key") % 7 != 0, own).alias("initial_intention"),
        "turns",
    )
    return rows.select("key", F.to_json(task).alias("json"))


def task_lines(spark: SparkSession, d: str) -> DataFrame:
    """The tasks, written as JSON lines in the order of their keys, and read."""
    path = f"{scratch_path(spark)}/tasks.jsonl"
    tasks(spark, d).orderBy("key").select("json").write.text(path)
    return readers.read_tasks(spark, path)


def task_files(spark: SparkSession, d: str) -> DataFrame:
    """The tasks, written as files with an array or one of the two lists, and read."""
    path = f"{scratch_path(spark)}/instances"
    chunk = F.floor(F.col("key") / FILE_INSTANCES)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("key", "json"))), lambda t: t["json"])
    files = tasks(spark, d).groupBy(chunk.alias("n")).agg(F.concat(F.lit("["), F.array_join(listed, ",\n"), F.lit("]")).alias("list"))
    inside = lambda name: F.concat(F.lit('{"%s": ' % name), "list", F.lit("}"))
    doc = F.when(F.col("n") % 3 == 0, F.col("list")).when(F.col("n") % 3 == 1, inside("instances")).otherwise(inside("tasks"))
    files.select(F.lpad(F.col("n").cast("string"), 12, "0").alias("chunk"), doc.alias("value")).write.partitionBy("chunk").text(path)
    return readers.read_trajectories(spark, path)


TASKS_SQL = """o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 turn_id from orders),
 per as (select o_custkey key, count(*) turns, arg_min(o_orderkey, turn_id) first_, arg_max(o_orderkey, turn_id) last_, cast(floor(arg_max(o_totalprice, turn_id)) as bigint) price, string_agg('say ' || o_orderkey, '|' order by turn_id) said from o group by 1),
 t as (select *, row_number() over (order by key) task_index from per),
 tasks as (select *, case when key % 5 <> 0 then 'c/' || key end given_id, case when key % 5 <> 0 then 'c/' || key else printf('webshop_task_%03d', task_index) end instance_id,
   case when key % 7 <> 0 then 'own ' || key when key % 21 <> 0 then 'want ' || first_ else 'say ' || first_ end request from t)"""


@query(f"with {TASKS_SQL} select cast(task_index as int) task_index, given_id instance_id, turns, said, case when key % 21 <> 0 then 'want ' || last_ end last_request, case when key % 21 <> 0 then '{{\"budget_max\":' || price || '}}' end last_constraints from tasks")
def read_trajectories(spark: SparkSession, d: str) -> DataFrame:
    last = F.try_element_at("turns", F.lit(-1))["gold_current_intention"]
    said = F.array_join(F.transform("turns", lambda t: t["user_utterance"]), "|")
    return task_files(spark, d).select("task_index", "instance_id", F.size("turns").cast("bigint").alias("turns"), said.alias("said"), last["request"].alias("last_request"), last["constraints"].alias("last_constraints"))


@query(f"with {TASKS_SQL} select cast(row_number() over (order by key % 3, key) as int) task_index, given_id instance_id, turns from tasks")
def union_task_files(spark: SparkSession, d: str) -> DataFrame:
    """The tasks, written as three files, and read together in the order of the files' names."""
    root, paths = scratch_path(spark), []
    for n in range(3):
        tasks(spark, d).where(F.col("key") % 3 == n).orderBy("key").select("json").write.text(f"{root}/part{n}.json")
        paths.append(f"{root}/part{n}.json")
    read = readers.union_task_files(spark, paths[::-1])
    return read.select("task_index", "instance_id", F.size("turns").cast("bigint").alias("turns"))


@query(f"with {TASKS_SQL} select cast(task_index as int) task_index, given_id instance_id, case when key % 5 <> 0 then 'explore' end task_type, turns from tasks")
def read_tasks(spark: SparkSession, d: str) -> DataFrame:
    return task_lines(spark, d).select("task_index", "instance_id", "task_type", F.size("turns").cast("bigint").alias("turns"))


@query(f"with {TASKS_SQL} select cast(task_index as int) task_index, instance_id, case when key % 5 <> 0 then 'explore' else 'transaction' end task_type, 'shopping' subtype, case when key % 2 = 0 then 'shop' else 'webshop' end \"domain\", request instruction, request, case when key % 21 = 0 then request end search_query from tasks")
def normalize_tasks(spark: SparkSession, d: str) -> DataFrame:
    world, wish = F.col("world_state"), F.col("initial_intention")
    made = readers.normalize_tasks(task_lines(spark, d))
    return made.select("task_index", "instance_id", "task_type", "subtype", world["domain"].alias("domain"), world["webshop_instruction_text"].alias("instruction"), wish["request"].alias("request"), wish["gold_search_query"].alias("search_query"))


@query(f"with {TASKS_SQL} select instance_id, turns, said, false shows_request, case when key % 21 <> 0 then turns else 0 end with_constraints from tasks")
def write_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances written again from their turns; the request of a turn's gold intention stays inside."""
    turns = readers.normalize_tasks(task_lines(spark, d)).select("instance_id", "task_type", "subtype", "world_state", F.explode("turns").alias("turn"))
    path = f"{scratch_path(spark)}/out"
    readers.write_instances(turns, path)
    wish = "gold_current_intention:struct<request:string,constraints:string>"
    back = spark.read.schema(f"instance_id string, turns array<struct<turn_id:int,user_utterance:string,{wish}>>").json(path)
    shows = F.exists("turns", lambda t: t["gold_current_intention"]["request"].isNotNull())
    held = F.size(F.filter("turns", lambda t: t["gold_current_intention"]["constraints"].isNotNull())).cast("bigint")
    said = F.array_join(F.transform("turns", lambda t: t["user_utterance"]), "|")
    return back.select("instance_id", F.size("turns").cast("bigint").alias("turns"), said.alias("said"), shows.alias("shows_request"), held.alias("with_constraints"))


@query(r"select cast(c_custkey as int) task_index, c_name || '/' || c_nationkey instance_id, printf('%02d_%s', c_custkey, regexp_replace(c_name || '/' || c_nationkey, '[^\p{L}\p{N}_.-]', '_', 'g')) file_key, 1 places from customer")
def write_split(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("task_index"), F.concat("c_name", F.lit("/"), F.col("c_nationkey").cast("string")).alias("instance_id"))
    path = f"{scratch_path(spark)}/split"
    readers.write_split(n, path, 500)
    places = spark.read.parquet(f"{path}/index").groupBy("file_key").agg(F.count("*").cast("int").alias("places"))
    return readers.read_split(spark, path, "task_index int, instance_id string").join(places, "file_key").select("task_index", "instance_id", "file_key", "places")


@query("select cast(p_partkey as varchar) asin, p_name title, case p_partkey % 3 when 1 then 'Upper' else 'lower' end brand, case when p_partkey % 2 = 0 then p_retailprice end price, '$' || p_size shown, cast(p_size as varchar) size, p_type bullet from part")
def read_catalog(spark: SparkSession, d: str) -> DataFrame:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    product = F.struct(
        key.cast("string").alias("asin"),
        F.col("p_name").alias("Title"),
        F.when(key % 2 == 0, F.array("p_retailprice")).alias("pricing"),
        F.concat(F.lit("$"), size).alias("Price"),
        F.array("p_type").alias("BulletPoints"),
        F.create_map(F.lit("Size"), F.array(size)).alias("options"),
    )
    # Two names that differ in case only can't stand in one struct.
    brands = F.when(key % 3 == 0, ',"brand":"lower"}').when(key % 3 == 1, ',"Brand":"Upper"}').otherwise(',"Brand":"Upper","brand":"lower"}')
    path = f"{scratch_path(spark)}/catalog"
    lines = p.select(F.concat(F.regexp_replace(F.to_json(product), r"\}$", ""), brands).alias("value"))
    lines.write.option("maxRecordsPerFile", 1000).text(path)
    back = readers.read_catalog(spark, path)
    return back.select("asin", F.col("Title").alias("title"), F.col("brand_name").alias("brand"), F.get("pricing", F.lit(0)).alias("price"), F.col("Price").alias("shown"), F.get(F.col("options")["Size"], F.lit(0)).alias("size"), F.get("BulletPoints", F.lit(0)).alias("bullet"))


@query(f"with {LOG_SQL} select date_trunc('hour', make_timestamp(cast(round(ts * 1000000) as bigint))) \"hour\", event, count(*) calls, count(request_count) counted, cast(sum(tokens) as bigint) tokens, count(distinct query || k) prompts from lg group by all")
def read_rerank_log(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_path(spark)}/log"
    call_log(spark, d).select("ts", "event", "request_count", "query", "k", "estimated_input_tokens").write.json(path)
    log = readers.read_rerank_log(spark, path)
    per = log.groupBy(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("hour"), "event")
    return per.agg(F.count("*").alias("calls"), F.count("request_count").alias("counted"), F.sum("estimated_input_tokens").alias("tokens"), F.countDistinct("query", "k").alias("prompts"))


@query("select case when role = 'user' then 'user' else 'unknown' end source, text prompt, case when turn % 2 = 0 then cast(conv_id as varchar) end conv, true timed from conversations")
def prompt_log(spark: SparkSession, d: str) -> DataFrame:
    c, path = table(spark, d, "conversations"), f"{scratch_path(spark)}/prompts"
    meta = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("conv"), F.col("conv_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = c.select(F.when(F.col("role") == "user", F.col("role")).otherwise("").alias("source"), F.col("text").alias("prompt"), meta.alias("metadata"))
    # Two appends, as two runs make them.
    readers.append_prompt_log(rows.where("source = 'user'"), path)
    readers.append_prompt_log(rows.where("source <> 'user'"), path)
    return readers.read_prompt_log(spark, path).select("source", "prompt", F.col("metadata")["conv"].alias("conv"), F.col("time").isNotNull().alias("timed"))


# Lists and pages --------------------------------------------------------------------------

EVENTS_SQL = "e as (select *, cast(json_extract(props, '$.k') as int) k from events)"


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query(f"with {EVENTS_SQL} select event_id, case when k % 5 <> 0 then 'status,feedback_type,page_type,candidate_items' || case when k % 2 = 0 then ',rerank_info' else '' end end shown, case when k % 5 <> 0 then 'candidate_items' end kind, case when k % 5 <> 0 then event_type end status from e")
def public_feedback(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.lit(c).cast("string")
    full = F.struct(F.col("event_type").alias("status"), text("internal").alias("feedback_type"), text("results").alias("page_type"), text("{}").alias("requested_constraints"), F.lit(None).cast(f"array<{readers.CANDIDATE}>").alias("candidate_items"), F.lit(None).cast(readers.CANDIDATE).alias("selected_candidate"), F.when(F.col("k") % 2 == 0, "{}").alias("rerank_info"))
    e = numbered_events(spark, d).withColumn("feedback", F.when(F.col("k") % 5 != 0, full))
    out = e.withColumn("public", readers.public_feedback(F.col("feedback")))
    shown = F.array_join(F.json_object_keys(F.to_json("public")), ",")
    return out.select("event_id", F.when(F.col("public").isNotNull(), shown).alias("shown"), F.col("public.feedback_type").alias("kind"), F.col("public.status").alias("status"))


def order_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, candidates): an order's known parts as a list, best first."""
    cands = ranked_lines(spark, d)[1].withColumn("row_id", F.substring("asin", 2, 20).cast("bigint"))
    known = cands.join(C.candidate_items(catalog(spark, d), "row_id").select("row_id", "candidate"), "row_id")
    item = F.col("candidate").withField("rank", F.col("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", item.alias("c"))), lambda a, b: a["place"] - b["place"])
    return known.groupBy("request_id").agg(F.transform(listed, lambda x: x["c"]).alias("candidates"))


@query(f"""with {CATALOG_SQL}, {RANKED_SQL}, known as (select request_id, place, catalog.asin, title, price, category, brand, color from cands join catalog on cands.asin = 'P' || catalog.asin),
 cut3 as (select *, row_number() over (partition by request_id order by place) n from known)
 select request_id, string_agg('{{"rank":' || place || ',"asin":"' || asin || '","title":"' || title || '","price":' || price || ',"category":"' || category || '","brand":"' || brand || '"' || coalesce(',"color":"' || color || '"', '') || '}}', ' ' order by place) items from cut3 where n <= 3 group by 1""")
def returned_items(spark: SparkSession, d: str) -> DataFrame:
    """What step histories keep of the first three items."""
    lists = order_candidates(spark, d).withColumn("visible_items", F.lit(None).cast(f"array<{readers.CANDIDATE}>"))
    return history_items(lists, 3).select("request_id", F.array_join("returned_items", " ").alias("items"))


@query(f"""with {EVENTS_SQL}, s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) step, case k % 3 when 0 then 'results' when 1 then 'item' else 'other' end page, case when k % 4 <> 0 then ['P' || (k % 5), 'P' || (k % 7 + 5)] else [] end own, case when k % 2 = 0 then 'p' || (k % 5) end item from e),
 l as (select *, coalesce(last_value(case when page = 'results' and len(own) > 0 then own end ignore nulls) over (partition by user_id order by step rows between unbounded preceding and 1 preceding), []) last_ from s)
 select user_id session_id, step, array_to_string(case when page = 'results' then own when page = 'item' and item is not null then list_concat([item], list_filter(last_, lambda x: x <> upper(item)))[:2] else last_ end, ',') shown from l""")
def carry_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    step = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    made = lambda asin: F.from_json(F.to_json(F.struct(asin.alias("asin"))), readers.CANDIDATE)
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    own = F.when(k % 4 != 0, F.array(made(name("P", k % 5)), made(name("P", k % 7 + 5)))).otherwise(C.empty_candidates())
    seen = numbered_events(spark, d).select(F.col("user_id").alias("session_id"), step.cast("bigint").alias("step"), F.when(k % 3 == 0, "results").when(k % 3 == 1, "item").otherwise("other").alias("page_type"), own.alias("candidates"), F.when(k % 2 == 0, made(name("p", k % 5))).alias("item_candidate"))
    return pages.carry_candidates(seen, limit=2).select("session_id", "step", F.array_join(F.transform("shown", lambda c: c["asin"]), ",").alias("shown"))


@query("select page_id, md5(substr(coalesce(html, ''), 1, 4000)) raw_text, md5(substr(coalesce(html, ''), 1, 3000)) description, least(len(string_split(html, '<')), 40) clickables, least(len(string_split(html, ' ')), 10) visible_items from pages")
def page_view(spark: SparkSession, d: str) -> DataFrame:
    """Pages cut for prompts; tags stand for clickables, words for items."""
    p = table(spark, d, "pages").select("page_id", F.col("html").alias("raw_text"), F.col("html").alias("description"), F.split("html", "<").alias("clickables"), F.split("html", " ").alias("visible_items"))
    size = lambda c: F.size(c).cast("bigint").alias(c)
    return pages.page_view(p).select("page_id", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("raw_text", "description")), size("clickables"), size("visible_items"))


@query("select cast(o_orderkey as bigint) task_index, o_custkey customer from orders order by o_orderkey limit 100")
def limit_instances(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("task_index"), F.col("o_custkey").alias("customer"))
    return readers.restore_order(readers.limit_instances(o, 100))


@query(f"""with {CATALOG_SQL}, wanted as (select lower(title) q from catalog where row_id = (select min(row_id) from catalog))
 select * from (select 'all' mode, asin, title from catalog order by row_id limit 20)
 union all select * from (select 'category', asin, title from catalog where category = 'promo' order by row_id limit 20)
 union all select * from (select 'query', asin, title from catalog where lower(title) = (select q from wanted) order by row_id limit 20)""")
def browse_modes(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    wanted = cat.agg(F.min_by("query", "row_id")).first()[0]
    found = [C.browse(cat, mode, arg, 20).select(F.lit(mode).alias("mode"), "asin", F.col("Title").alias("title")) for mode, arg in (("all", ""), ("category", "promo"), ("query", wanted))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""with c as (select c_custkey k from customer)
 select k id, case k % 4 when 0 then 'red shoe ' || k when 1 then 'q' || k when 2 then 'r' else 'u' || k end query, cast(k as double) + 0.5 price,
  ['office chair', 'jumpsuit', 'shirt', 'shoes', null][k % 5 + 1] hint, [null, 'red', 'blue', null, null][k % 5 + 1] color,
  case when k % 3 = 0 then '' else 'find ' || k end instruction, 'get ' || k cleaned, case when k % 3 = 0 then -1 else k end number, 'a ' || k list, 'a' first_keys,
  ['budget_max', 'category', 'odd_key'][k % 3 + 1] key, case when k % 2 = 0 then cast('1' || k as double) end amount, case when k % 2 <> 0 then 'under $1,' || k end plain,
  case when k % 2 <> 0 then 'say ' || k when k % 3 = 0 then '' else 'req ' || k end said, case when k % 3 = 0 then 'Buy Now' else 'name ' || k end item_title, case when k % 3 <> 0 then cast(k as double) end item_price from c""")
def request_columns(spark: SparkSession, d: str) -> DataFrame:
    """Requests, hints, keys and item pages made of customers, through the column functions."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    n, none = k.cast("string"), F.lit(None).cast("string")
    of = lambda m, *texts: F.element_at(F.array(*map(F.lit, texts)), (k % m + 1).cast("int"))
    free = F.concat(of(5, "Office Chair", "red jumpsuit", "a shirt in BLUE", "shoe", "lamp"), F.lit(" for $"), n, F.lit(".50"))
    hints = T.attrs_from_text(free)
    asked = F.when(k % 3 == 0, "nothing").otherwise(F.concat(F.lit("x Instruction: find "), n, F.lit(" [SEP] Search")))
    value = T.constraint_value(F.when(k % 2 == 0, "budget_max").otherwise("color"), F.concat(F.lit(" under  $1,"), n))
    page = F.when(k % 3 == 0, "Buy Now\nthe rest").otherwise(F.concat(F.lit("Buy Now [SEP] < Prev [SEP] name "), n, F.lit(" [SEP] Price: $"), n, F.lit(" [SEP] more")))
    context = F.lit(None).cast("struct<title:string,pricing:array<double>,price:double,asin:string,category:string,product_category:string,rating:string,brand:string,color:string>")
    item = pages.selected_item(page, F.lit("item"), context)
    return c.select(
        k.alias("id"),
        T.resolve_query(F.when(k % 4 == 0, F.concat(F.lit("  red  shoe "), n)).otherwise(" None"), F.when(k % 4 == 1, F.concat(F.lit("q"), n)), F.when(k % 4 == 2, " r ").otherwise(""), F.concat(F.lit("u"), n)).alias("query"),
        hints["price"].alias("price"),
        hints["category"].alias("hint"),
        hints["color"].alias("color"),
        T.instruction_from_text(asked).alias("instruction"),
        T.clean_request(F.concat(F.lit(" instruction: get "), n, F.lit(" "))).alias("cleaned"),
        T.coerce_int(F.when(k % 3 == 0, "x").otherwise(F.concat(F.lit(" "), n)), F.lit(-1)).cast("bigint").alias("number"),
        F.array_join(T.string_list(F.array(F.concat(F.lit(" a  "), n), F.lit(" "), none)), "|").alias("list"),
        F.array_join(F.map_keys(T.limit_map(F.create_map(F.lit("a"), n, F.lit("b"), n), 1)), ",").alias("first_keys"),
        T.constraint_key(of(3, " Max-Price ", "Item  Type", "odd__Key_")).alias("key"),
        F.when(k % 2 == 0, value.cast("double")).alias("amount"),
        F.when(k % 2 != 0, value).alias("plain"),
        I.turn_utterance(F.when(k % 2 == 0, "  ").otherwise(F.concat(F.lit("say "), n)), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("req "), n))).alias("said"),
        item["title"].alias("item_title"),
        item["price"].alias("item_price"),
    )


# A customer asks for one page of the catalogue, by one of the three modes.
@query(f"""with {CATALOG_SQL}, asked as (select c_custkey request_id, case c_custkey % 3 when 0 then 'all' when 1 then 'category' else 'query' end mode, 1 + c_custkey % 20 lim, 1 + c_custkey % (select count(*) from catalog) own from customer),
 req as (select request_id, mode, lim, case mode when 'all' then '' when 'category' then c.category else lower(c.title) end arg from asked join catalog c on c.row_id = own),
 entries as (select 'all' mode, '' arg, row_id, asin from catalog union all select 'category', category, row_id, asin from catalog union all select 'query', lower(title), row_id, asin from catalog),
 placed as (select *, row_number() over (partition by mode, arg order by row_id) n from entries)
 select request_id, cast(n as int) "rank", asin from req join placed using (mode, arg) where n <= lim""")
def browse_requests(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    k, parts = F.col("c_custkey"), cat.agg(F.count("*").alias("parts"))
    asked = table(spark, d, "customer").crossJoin(parts).select(k.alias("request_id"), F.when(k % 3 == 0, "all").when(k % 3 == 1, "category").otherwise("query").alias("mode"), (1 + k % 20).cast("int").alias("limit"), (1 + k % F.col("parts")).alias("own"))
    own = cat.select(F.col("row_id").alias("own"), "category", "query")
    requests = asked.join(own, "own").select("request_id", "mode", "limit", F.when(F.col("mode") == "category", F.col("category")).otherwise(F.col("query")).alias("arg"))
    return C.browse_requests(cat, requests).select("request_id", "rank", "asin")


# Bulk model jobs --------------------------------------------------------------------------


def payload(prompt: str) -> dict:
    """The JSON object of a prompt, which other text may follow."""
    return json.JSONDecoder().raw_decode(prompt.partition("\n\n")[2])[0]


class Repeats:
    """A stand-in shopper: it gives the timeline back as its answer."""

    def generate(self, prompt: str) -> str:
        return f"Well: {payload(prompt)['intention_timeline']}"


@query(NORMAL_SQL + " select * from normal")
def bulk_shifts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of normalize_shifts by way of prompts and answers."""
    raw = raw_shifts(spark, d)
    given = F.struct("intention_changed", "condition", "category", "op", "field", "value", F.col("update").alias("priority_update"), "rationale")
    answer = F.when(F.col("usable"), F.to_json(given)).otherwise("I don't know.")
    turns = raw.select("instance_id", "turn_id", answer.alias("timeline"), F.lit("{}").alias("feedback"), "constraints", "fields", "priority", "request", "stored_query")
    out = bulk.bulk_shifts(turns, Repeats)
    return out.withColumn("priority_update", F.array_join("priority_update", ",")).drop("utterance_plan")


class Seeker:
    """A stand-in that writes a query for intentions of even numbers, and fails for every fifth."""

    def generate(self, prompt: str) -> str:
        n = int(payload(prompt)["updated_gold_intention"])
        if n % 5 == 0:
            raise TimeoutError("busy")
        return json.dumps({"gold_search_query": f" query  {n} " if n % 2 == 0 else "none"})


@query(f"with {WISHES_SQL} select request_id, case when request_id % 2 = 0 and request_id % 5 <> 0 then 'query ' || request_id else coalesce(nullif(concat_ws(' ', w_category, case when request_id % 7 <> 4 then ['Red','blue','green'][request_id % 3 + 1] end, w_brand, w_size), ''), 'anything') end gold_search_query from wishes")
def bulk_queries(spark: SparkSession, d: str) -> DataFrame:
    value = lambda f: F.get(F.filter("constraints", lambda c: c["field"] == f), F.lit(0))["value"].alias(f)
    none = F.lit(None).cast("string")
    intents = wishes(spark, d).select("request_id", F.col("request_id").cast("string").alias("intention"), none.alias("delta"), none.alias("stored_query"), *map(value, ("category", "color", "brand", "size")), F.lit("anything").alias("request"))
    return bulk.bulk_queries(intents, Seeker).select("request_id", "gold_search_query")


class Speaker:
    """A stand-in that says a shift in two words, and nothing where nothing changes."""

    def generate(self, prompt: str) -> str:
        p = payload(prompt)
        return " " if p["op"] == "none" else f" {p['op']} {p['field']} "


@query(f"with {SHIFTS_SQL} select instance_id, cast(turn_id as int) turn_id, case op when 'none' then 'Let''s keep looking.' else op || ' ' || field end utterance from shifts")
def bulk_utterances(spark: SparkSession, d: str) -> DataFrame:
    plan = F.struct(F.lit("explicit").alias("style"), F.lit(False).alias("mention_old_value"))
    made = order_shifts(spark, d)[1].withColumns({"old_value": F.lit(None).cast("string"), "utterance_plan": plan})
    return bulk.bulk_utterances(made, Speaker).select("instance_id", "turn_id", "utterance")


class Clicker:
    """A stand-in that searches, clicks, refuses or buys, by the number in its view."""

    def generate(self, prompt: str) -> str:
        k = int(payload(prompt)["view"])
        kinds = [("search", {"query": f"q{k}"}), ("Open", {"target": "RED"}), None, ("purchase", {})]
        kind = kinds[k % 4]
        return json.dumps({"action_type": kind[0], "action_payload": kind[1]}) if kind else "I can't."


@query(f"""with {EVENTS_SQL}, a as (select event_id, k, case when k % 4 = 0 then 'search' when k % 4 = 1 then 'click' when k % 4 = 3 and k % 3 = 0 then 'buy' end model from e)
 select event_id, case when model is not null then model when k % 3 = 0 then case when k % 2 = 0 then 'buy' else 'click' end when k % 3 = 1 then case when k % 5 <> 0 then 'click' else 'refine' end else 'search' end action,
  case when model = 'search' then 'q' || k when model = 'click' then 'red' when model = 'buy' then '' when k % 3 = 0 then case when k % 2 = 0 then '' else 'red' end when k % 3 = 1 then case when k % 5 <> 0 then 'b1' else 'a red shoe' end else 'a red shoe' end argument from a""")
def bulk_actions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    shown = F.array(F.struct(F.lit("B1").alias("asin"), F.lit("t").alias("title"), F.lit(None).cast("double").alias("price"), F.lit("b1").alias("click_target")))
    none = F.create_map().cast("map<string,string>")
    seen = numbered_events(spark, d).select(
        "event_id",
        k.cast("string").alias("view"),
        F.lit("[]").alias("context"),
        F.lit(" a red shoe ").alias("utterance"),
        F.when(k % 3 == 0, "Item").when(k % 3 == 1, "results").otherwise("search").alias("page_type"),
        F.array(F.lit("red"), F.lit("buy now")).alias("clickables"),
        F.when(k % 5 != 0, shown).otherwise(F.slice(shown, 1, 0)).alias("visible_items"),
        F.create_map(F.lit("Color"), F.array(F.lit("Blue"), F.lit("Red"))).alias("options"),
        F.when(k % 2 == 0, F.create_map(F.lit("Color"), F.lit("red"))).otherwise(none).alias("selected_options"),
    )
    act = F.col("next_action")
    return bulk.bulk_actions(seen, Clicker).select("event_id", act["action_type"].alias("action"), F.coalesce(act["payload"]["query"], act["payload"]["target"], F.lit("")).alias("argument"))


class Parser:
    """A stand-in that turns an instruction into an intention, or fails for every fourth."""

    def generate(self, prompt: str) -> str:
        n = int(prompt.rpartition(" ")[2])
        if n % 4 == 0:
            return "Sorry."
        return "```json\n" + json.dumps({"constraints": {"Max Price": f"${n}", "color": "none", "size_exact": "9", "Item Type": f" lamp  {n} "}, "priority": ["product_type", "x"]}) + "\n```"


@query("with c as (select c_custkey k from customer) select k id, 'a lamp ' || k request, case when k % 4 = 0 then '' else 'budget_max,category' end fields, case when k % 4 = 0 then '' else 'category,budget_max' end priority, case when k % 4 <> 0 then cast(k as double) end budget, case when k % 4 = 0 then 'a lamp ' || k else 'lamp ' || k end query from c")
def bulk_initial_intentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" Instruction: a lamp "), F.col("c_custkey").cast("string")).alias("instruction"))
    got = bulk.bulk_initial_intentions(rows, Parser)
    i = F.col("intention")
    held = F.filter(i["constraints"], lambda c: c["field"] == "budget_max")
    return got.select("id", i["request"].alias("request"), F.array_join(F.transform(i["constraints"], lambda c: c["field"]), ",").alias("fields"), F.array_join(i["priority"], ",").alias("priority"), F.get(held, F.lit(0))["value"].cast("double").alias("budget"), i["gold_search_query"].alias("query"))


class Bluer:
    """A stand-in that wants blue if the size is known, asks for blue lamps, and says one sentence."""

    def generate(self, prompt: str) -> str:
        p = payload(prompt)
        if "intention_timeline" in p:
            known = {c["field"]: c.get("value") for c in json.loads(p["intention_timeline"])["constraints"]}
            if known.get("size") is None:
                return json.dumps({"intention_changed": False})
            return json.dumps({"intention_changed": True, "category": "override", "op": "override", "field": "color", "value": "blue", "rationale": "r"})
        return json.dumps({"gold_search_query": "blue lamp"}) if "updated_gold_intention" in p else "Another one, please."


@query(CATALOG_SEARCH_SQL + """, tops as (select query_id, string_agg(cast(doc_id as varchar), ',' order by rank) found from ranked where rank <= 10 group by 1),
 a as (select c_custkey k, c_custkey % 7 <> 5 moved, lower(['ECONOMY','STANDARD','PROMO','SMALL','MEDIUM','LARGE'][c_custkey % 6 + 1]) || ' ' || ['red','blue','small','large','widget'][c_custkey % 5 + 1] asked, case when c_custkey % 7 <> 4 then [' Red','blue ','green'][c_custkey % 3 + 1] end color from customer)
 select k instance_id, coalesce(found, '') found, case when moved then 'override' else 'none' end op, case when moved then color end old_value, case when moved then 'blue' else color end next_color, 'category,budget_max,brand,color,size,material' next_priority, case when moved then 'blue lamp' else asked end next_query, k % 3 = 0 and not moved ended from a left join tops on query_id = k""")
def advance_round(spark: SparkSession, d: str) -> DataFrame:
    """One round of all customers' dialogues."""
    cat = catalog(spark, d)
    posted = search.postings(cat.select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "Title", F.upper("category")).alias("text")))
    start = wishes(spark, d).select(F.col("request_id").alias("instance_id"), F.lit(0).alias("turn_id"), "query", "constraints", F.array().cast("array<string>").alias("priority"), F.lit("anything").alias("request"), (F.col("request_id") % 3 == 0).alias("done"))
    out = bulk.advance_round(start, posted, cat, Bluer)
    color = F.get(F.filter("next_constraints", lambda c: c["field"] == "color"), F.lit(0))["value"]
    return out.select("instance_id", F.coalesce(F.array_join("found", ","), F.lit("")).alias("found"), "op", "old_value", color.alias("next_color"), F.array_join("next_priority", ",").alias("next_priority"), "next_query", "ended")
