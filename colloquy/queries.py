"""The registered queries over the given tables, and SQL that gives the same rows.

The tables hold no shopping dialogues, so each query reads a view of them: parts are the
catalogue, customers have wishes, order lines are a model's ranked rows, orders are changes of
wishes, events are steps of a turn and calls of a log, conversations are turns, pages are pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import shifts as S
from .functions import text as T
from .operators import candidates as C
from .operators import constraints as K
from .operators import intentions as I
from .operators import logs, pages, rerank, search, steps
from .plans import bulk
from .sources import readers
from .sources.scratch import scratch_path
from .sources.scratch import stored as scratch_stored
from .streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: White space of Unicode, as DuckDB's expressions write it.
SP = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Views ----------------------------------------------------------------------------------

def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts as products."""
    p = table(spark, d, "part")
    text = lambda c: F.lit(c).cast("string")
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_partkey").cast("string").alias("asin"),
        F.col("p_name").alias("Title"),
        text(None).alias("name"),
        F.when(F.col("p_partkey") % 5 != 0, F.array("p_retailprice", F.col("p_retailprice") + 1, F.col("p_retailprice") + 2)).alias("pricing"),
        F.concat(F.lit("now $"), F.floor("p_retailprice").cast("string"), F.lit(" only")).alias("Price"),
        F.array(F.concat(F.lit("  for \t"), F.col("p_type"), F.lit("  use ")), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("BulletPoints"),
        F.array("p_type", "p_brand").alias("Attributes"),
        F.create_map(F.lit("Size"), F.array(F.col("p_size").cast("string"))).alias("options"),
        F.concat("p_name", F.lit("  of "), "p_type").alias("Description"),
        text(None).alias("full_description"),
        F.lower("p_type").alias("category"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("product_category"),
        F.lower("p_name").alias("query"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("brand_name"),
    )


CATALOG_SQL = """catalog as (
  select p_partkey row_id, cast(p_partkey as varchar) asin, p_name title, p_type, p_brand, p_size,
    case when p_partkey % 5 <> 0 then p_retailprice else floor(p_retailprice) end price,
    lower(p_type) category, case when p_partkey % 3 <> 0 then p_type end product_category,
    case when p_partkey % 4 <> 0 then p_brand else p_name end brand,
    case when contains(p_name,'black') then 'black' when contains(p_name,'white') then 'white' when contains(p_name,'gray') then 'gray' when contains(p_name,'grey') then 'grey' when contains(p_name,'blue') then 'blue' when contains(p_name,'red') then 'red' when contains(p_name,'green') then 'green' when contains(p_name,'teal') then 'teal' when contains(p_name,'pink') then 'pink' when contains(p_name,'brown') then 'brown' end color
  from part)"""

TYPES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")


def wishes(spark: SparkSession, d: str) -> DataFrame:
    """Customers with constraints: an array of (field, value) in order, some values null."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    unless = lambda n, v: F.when(key % 7 != n, v)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (key % 6 + 1).cast("int"))
    rows = [("category", unless(1, F.lower(kind))), ("budget_max", unless(2, (900 + key % 100).cast("string"))), ("brand", unless(3, F.concat(F.lit("brand#"), (1 + key % 25).cast("string")))), ("color", unless(4, F.element_at(F.array(*map(F.lit, (" Red", "blue ", "green"))), (key % 3 + 1).cast("int")))), ("size", unless(5, (1 + key % 50).cast("string"))), ("material", F.lit("steel"))]
    entries = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in rows])
    return c.select(key.alias("request_id"), entries.alias("constraints"), F.concat_ws(" ", F.lower(kind), F.element_at(F.array(*map(F.lit, ("red", "blue", "small", "large", "widget"))), (key % 5 + 1).cast("int"))).alias("query"))


WISHES_SQL = """wishes as (
  select c_custkey request_id,
    case when c_custkey % 7 <> 1 then lower(['ECONOMY','STANDARD','PROMO','SMALL','MEDIUM','LARGE'][c_custkey % 6 + 1]) end w_category,
    case when c_custkey % 7 <> 2 then cast(900 + c_custkey % 100 as varchar) end w_budget,
    case when c_custkey % 7 <> 3 then 'brand#' || (1 + c_custkey % 25) end w_brand,
    case when c_custkey % 7 <> 4 then ['red','blue','green'][c_custkey % 3 + 1] end w_color,
    case when c_custkey % 7 <> 5 then cast(1 + c_custkey % 50 as varchar) end w_size
  from customer)"""

# The checks of each customer's wishes against each part of the customer's own order lines.
OWNED_SQL = "pairs as (select w.*, c.*, row_id part from (select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey) join wishes w on request_id = o_custkey join catalog c on row_id = l_partkey)"
CHECKS_SQL = f"""with {CATALOG_SQL}, {WISHES_SQL}, {OWNED_SQL},
 cat as (select *, lower(w_category) want, lower(coalesce(product_category, category)) act from pairs),
 n as (select *, case when length(want) > 3 and ends_with(want, 's') then want[:-2] else want end nw from cat),
 checks as (
  select request_id, part, 1 pos, 'category' field, (contains(lower(p_type), nw) or contains(nw, lower(p_type)) or contains(lower(title), nw) or contains(nw, lower(title))) matched, true known from n where w_category is not null
  union all select request_id, part, 2, 'budget_max', price <= cast(w_budget as double), price is not null from n where w_budget is not null
  union all select request_id, part, 3, 'brand', lower(brand) = w_brand, brand is not null from n where w_brand is not null
  union all select request_id, part, 4, 'color', case when color is not null then color = w_color end, color is not null from n where w_color is not null
  union all select request_id, part, 5, 'size', null, false from n where w_size is not null)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's wishes beside each part of the customer's own order lines."""
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    owned = lines.select(F.col("o_custkey").alias("request_id"), F.col("l_partkey").alias("part")).distinct()
    items = C.candidate_items(catalog(spark, d), "row_id").select("row_id", "candidate")
    # What is compared is made of products and of customers, which are far fewer than pairs.
    asked = wishes(spark, d).withColumn("constraints", K.plain_wishes(F.col("constraints")))
    items = items.withColumns({"texts": K.category_texts(candidate_result()), "plain": K.plain_values(candidate_result())})
    return asked.join(owned, "request_id").join(items, F.col("part") == F.col("row_id"))


def candidate_result(c="candidate") -> dict:
    return {f: F.col(c)[f] for f in ("price", "color", "brand", "category", "product_category", "title", "query")}


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    return K.evaluate_constraints(pairs(spark, d), candidate_result() | {"texts": F.col("texts"), "plain": F.col("plain")})


def ranked_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(a model's rows, candidates): order lines in a total order, and the same parts without some, once each."""
    li = table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    rows = li.select(F.col("l_orderkey").alias("request_id"), pos.cast("int").alias("pos"), F.concat(F.lit(" p"), F.col("l_partkey").cast("string")).alias("asin"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("string")).otherwise("none").alias("new_rank"), F.col("l_returnflag").alias("decision"))
    found = li.where(F.col("l_partkey") % 29 != 0).groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("q"), "l_partkey")).cast("int")
    cands = found.select(F.col("l_orderkey").alias("request_id"), place.alias("place"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("asin"), place.alias("rank"))
    return rows, cands


RANKED_SQL = """rows_ as (select l_orderkey request_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) pos, 'P' || l_partkey asin, case when l_linenumber % 3 <> 0 then l_linenumber end new_rank, l_returnflag decision from lineitem),
 found as (select l_orderkey, l_partkey, max(l_quantity) q from lineitem where l_partkey % 29 <> 0 group by all),
 cands as (select l_orderkey request_id, row_number() over (partition by l_orderkey order by q desc, l_partkey) place, 'P' || l_partkey asin from found),
 cut as (select * from rows_ where pos <= 4),
 judged as (select cut.*, cands.place c_rank, cands.asin is null or count(*) over (partition by cut.request_id, cut.asin) > 1 bad, cands.asin is null unknown_ from cut left join cands on cut.request_id = cands.request_id and cut.asin = cands.asin),
 failed as (select request_id, arg_min(case when unknown_ then 'unknown id' else 'duplicate id' end, pos) error from judged where bad group by 1),
 good as (select request_id, pos, asin, c_rank original_rank, coalesce(new_rank, pos) rerank_rank, decision from judged where request_id not in (select request_id from failed)),
 results as (
  select request_id, pos, asin, original_rank, rerank_rank, cast(null as varchar) fallback, cast(null as varchar) error from good
  union all select cands.request_id, place, asin, place, null, 'bm25_top10', error from cands join failed using (request_id) where place <= 4)"""


def event_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps of turns: a user's day is a turn."""
    e = table(spark, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "turn_id": F.date_format("ts", "yyyy-MM-dd")})
    nth = F.row_number().over(W.partitionBy("user_id", "turn_id").orderBy("ts", "event_id"))
    none = F.create_map().cast("map<string,string>")
    return e.select(
        F.col("user_id").alias("instance_id"),
        "turn_id",
        F.col("ts").cast("timestamp").alias("time"),
        nth.alias("step_index"),
        F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "view", "search").otherwise(F.col("event_type")).alias("action_type"),
        F.create_map(F.lit("query"), F.concat(F.lit(" Q"), (F.col("k") % 3).cast("string"))).alias("action_payload"),
        F.when(F.col("k") % 4 == 0, "search").when(F.col("k") % 4 == 1, "results").when(F.col("k") % 4 == 2, "item").otherwise("other").alias("page_type"),
        F.when(F.col("k") % 3 == 0, (F.col("k") % 10).cast("string")).alias("selected_asin"),
        F.lit(None).cast("string").alias("result_asin"),
        F.when(F.col("k") % 5 == 0, F.create_map(F.lit("Color"), (F.col("k") % 2).cast("string"))).otherwise(none).alias("selected_options"),
        F.when(F.col("k") % 2 == 0, F.array((F.col("k") % 7).cast("string"))).otherwise(F.array().cast("array<string>")).alias("visible_asins"),
        F.lit("").alias("title"),
        F.when(F.col("k") % 2 == 0, (F.col("k") % 5).cast("double")).alias("price"),
        F.when(F.col("k") % 6 == 0, F.array(F.lit("color"))).otherwise(F.array().cast("array<string>")).alias("satisfied"),
        F.when(F.col("event_type") == "error", "error").otherwise("observed").alias("status"),
        (F.col("k") == 99).alias("env_done"),
        F.lit(False).alias("all_satisfied"),
        (F.col("k") == 50).alias("ready"),
        "k",
    )


STEPS_SQL = """raw as (select *, cast(json_extract(props, '$.k') as int) k, strftime(ts, '%Y-%m-%d') turn_id from events),
 s0 as (select user_id instance_id, turn_id, row_number() over (partition by user_id, turn_id order by ts, event_id) step_index, case event_type when 'purchase' then 'buy' when 'view' then 'search' else event_type end action_type, 'q' || (k % 3) q, ' Q' || (k % 3) rawq, k,
   case k % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 0 end rank_, case k % 4 when 0 then 'search' when 1 then 'results' when 2 then 'item' else 'other' end page, case when k % 3 = 0 then cast(k % 10 as varchar) end asin, case when k % 5 = 0 then 'o' || (k % 2) else '' end opt, case when k % 2 = 0 then cast(k % 7 as varchar) else '' end vis, case when k % 2 = 0 then cast(k % 5 as double) end price, case when k % 6 = 0 then 1 else 0 end sat, event_type = 'error' is_error from raw),
 s1 as (select *, lag(step_index) over w prev, lag(rank_) over w p_rank, lag(page) over w p_page, lag(asin) over w p_asin, lag(opt) over w p_opt, lag(vis) over w p_vis, lag(price) over w p_price, lag(sat) over w p_sat, lag(action_type) over w p_act, lag(q) over w p_q from s0 window w as (partition by instance_id, turn_id order by step_index)),
 s2 as (select *, prev is null or page <> p_page or coalesce(asin,'') <> coalesce(p_asin,'') or opt <> p_opt or vis <> p_vis or price is distinct from p_price or sat <> p_sat state_changed,
   prev is null or rank_ > p_rank or (asin is not null and asin is distinct from p_asin) or opt <> p_opt or sat > p_sat or (vis <> '' and vis <> p_vis) made_progress, case when prev is not null and action_type = p_act and q = p_q then 0 else 1 end new_run from s1),
 s3 as (select *, sum(new_run) over w run, sum(case when made_progress then 1 else 0 end) over w grp from s2 window w as (partition by instance_id, turn_id order by step_index)),
 s4 as (select *, row_number() over (partition by instance_id, turn_id, run order by step_index) repeat_streak, sum(case when made_progress then 0 else 1 end) over (partition by instance_id, turn_id, grp order by step_index) stagnant_steps from s3),
 s5 as (select *, case when action_type = 'buy' then 'virtual_buy' when is_error then 'error' when k = 99 then 'env_done' when k = 50 then 'candidate_ready' when repeat_streak >= 2 or stagnant_steps >= 2 then 'stuck' when step_index >= 12 then 'step_budget' end stop_reason from s4),
 s6 as (select *, min(case when stop_reason is not null then step_index end) over (partition by instance_id, turn_id) last_ from s5),
 stopped as (select * from s6 where last_ is null or step_index <= last_)"""


def judged_steps(spark: SparkSession, d: str) -> DataFrame:
    s = event_steps(spark, d)
    return steps.stagnant_steps(steps.repeat_streak(steps.made_progress(steps.state_changed(s))))


def order_shifts(spark: SparkSession, d: str, timed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(initial wishes, shifts): a customer is a dialogue, each order a turn's shift; timed adds the column time."""
    o = table(spark, d, "orders")
    nth = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("int")
    op = F.when(F.col("o_orderkey") % 11 == 0, "none").when(F.col("o_orderkey") % 13 == 0, "reprioritize").when(F.col("o_orderstatus") == "F", "relax").when(F.col("o_orderstatus") == "O", "override").otherwise("add")
    field = F.lower(F.element_at(F.split("o_orderpriority", "-"), 2))
    made = o.select(F.col("o_custkey").alias("instance_id"), nth.alias("turn_id"), op.alias("op"), F.when(op != "none", field).alias("field"), F.when(op.isin("add", "override"), F.floor("o_totalprice").cast("string")).alias("value"), F.concat(F.lit("r"), (F.col("o_orderkey") % 9).cast("string")).alias("rationale"), F.when(op == "reprioritize", F.array(F.upper(field), F.lit("nowhere"))).otherwise(F.array().cast("array<string>")).alias("priority_update"), F.when(F.col("o_orderkey") % 2 == 0, "user_preference").otherwise("real_world_feasibility").alias("condition"), *([F.col("o_orderdate").cast("timestamp").alias("time")] * timed))
    c = table(spark, d, "customer")
    first = c.select(F.col("c_custkey").alias("instance_id"), F.lit("low").alias("field"), F.lit("1").alias("value")).unionByName(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("instance_id"), F.lit("high").alias("field"), F.lit(None).cast("string").alias("value")))
    return first, made


SHIFTS_SQL = """sh as (select o_custkey instance_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 turn_id,
   case when o_orderkey % 11 = 0 then 'none' when o_orderkey % 13 = 0 then 'reprioritize' when o_orderstatus = 'F' then 'relax' when o_orderstatus = 'O' then 'override' else 'add' end op, lower(split_part(o_orderpriority, '-', 2)) f0, o_totalprice, o_orderkey from orders),
 shifts as (select instance_id, turn_id, op, case when op <> 'none' then f0 end field, case when op in ('add','override') then cast(cast(floor(o_totalprice) as bigint) as varchar) end value, 'r' || (o_orderkey % 9) rationale, case when o_orderkey % 2 = 0 then 'user_preference' else 'real_world_feasibility' end condition from sh),
 init as (select c_custkey instance_id, 'low' field, '1' value from customer union all select c_custkey, 'high', null from customer where c_custkey % 2 = 0),
 given as (select instance_id, -1 turn_id, field, 'initial' op, value, null rationale from init union all select instance_id, turn_id, field, op, value, rationale from shifts where op in ('add','relax','override','scope_correction'))"""


def raw_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Shifts as a model gives them, beside the state that they change."""
    first, made = order_shifts(spark, d)
    state = first.groupBy("instance_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("constraints"),
        F.array_sort(F.collect_list("field")).alias("fields"),
    )
    turn, text = F.col("turn_id"), F.lit(None).cast("string")
    raw = {
        "usable": turn % 17 != 0,
        "intention_changed": F.when(turn % 3 != 0, F.col("op") != "none"),
        "condition": F.upper(F.replace("condition", F.lit("_"), F.lit("-"))),
        "category": F.when(turn % 2 == 0, F.col("op")),
        "field": F.upper("field"),
        "old_value": text,
        "update": F.col("priority_update"),
        "priority": F.array().cast("array<string>"),
        "request": F.lit("anything"),
        "stored_query": text,
        "style": F.lit("PARTIAL "),
        "directness": text,
        "mention_old_value": F.lit(None).cast("boolean"),
        "gold_search_query": text,
    }
    return made.join(state, "instance_id").withColumns(raw).drop("priority_update")


def seconds(c: str):
    """Seconds since 1970 of a time without a zone, whatever the session's zone is."""
    return (F.unix_date(F.to_date(c)) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60).cast("double") + F.extract(F.lit("SECOND"), F.col(c)).cast("double")


def call_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a call log: clicks ask, views answer, errors fall back, purchases hit the cache; a counter a user's day."""
    e = table(spark, d, "events").where("event_type <> 'signup'").withColumn("day", F.to_date("ts"))
    count = F.count_if(F.col("event_type") == "click").over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "fallback").otherwise("cache_hit")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(F.col("user_id").alias("caller_id"), seconds("ts").alias("ts"), "event_id", kind.alias("event"), F.greatest(count, F.lit(1)).alias("c"), F.concat(F.lit("q"), (k % 20).cast("string")).alias("query"), (k % 2 + 50).alias("k"), F.when(kind == "request", (F.col("value") * 10).cast("bigint")).alias("estimated_input_tokens"))
    return rows.withColumn("request_count", F.when(F.col("event") != "cache_hit", F.col("c"))).drop("c")


LOG_SQL = """l0 as (select user_id caller_id, epoch_us(ts) / 1e6 ts, event_id, case event_type when 'click' then 'request' when 'view' then 'success' when 'error' then 'fallback' else 'cache_hit' end event, greatest(1, count(*) filter (event_type = 'click') over (partition by user_id, cast(ts as date) order by ts, event_id)) c, 'q' || (cast(json_extract(props, '$.k') as int) % 20) query, cast(json_extract(props, '$.k') as int) % 2 + 50 k, value from events where event_type <> 'signup'),
 l1 as (select *, case when event <> 'cache_hit' then c end request_count, case when event = 'request' then cast(trunc(value * 10) as bigint) end tokens from l0),
 l2 as (select *, last_value(request_count ignore nulls) over (partition by caller_id order by ts, event_id rows between unbounded preceding and 1 preceding) before_ from l1),
 lg as (select *, 1 + sum(case when request_count < before_ then 1 else 0 end) over (partition by caller_id order by ts, event_id) session from l2)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return logs.sessionize_log(call_log(spark, d), "caller_id", ("ts", "event_id"))


def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    said = F.regexp_extract("text", r"^\S+", 0)
    return c.select(F.col("conv_id").alias("instance_id"), F.col("turn").alias("turn_id"), "role", "text", F.when(F.col("turn") % 3 == 0, said).alias("gold_intention"), said.alias("intention"), F.col("turn").cast("string").alias("delta"))


# Queries ----------------------------------------------------------------------------------


@query(f"with {CATALOG_SQL} select asin, row_id rank, title, price, category, product_category, brand, color, title || ' of ' || p_type description, 'for ' || p_type || ' use|size ' || p_size bullets from catalog")
def candidate_items(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("candidate")
    made = C.candidate_items(catalog(spark, d), "row_id")
    return made.select(c["asin"].alias("asin"), F.col("row_id").alias("rank"), *(c[f].alias(f) for f in ("title", "price", "category", "product_category", "brand", "color", "description")), F.array_join(c["bullet_points"], "|").alias("bullets"))


@query(f"with {CATALOG_SQL} select asin, row_id original_rank, title, price, coalesce(product_category, category) product_category, p_type || '|' || p_brand attributes, 'for ' || p_type || ' use|size ' || p_size bullets, title || ' of ' || p_type description from catalog")
def compact_candidates(spark: SparkSession, d: str) -> DataFrame:
    made = C.compact_candidates(C.candidate_items(catalog(spark, d), "row_id"), include_description=True)
    c = F.col("compact")
    return made.select(c["asin"].alias("asin"), c["original_rank"].cast("bigint").alias("original_rank"), *(c[f].alias(f) for f in ("title", "price", "product_category")), F.array_join(c["attributes"], "|").alias("attributes"), F.array_join(c["bullet_points"], "|").alias("bullets"), c["description"].alias("description"))


@query(f"with {CATALOG_SQL} select l_orderkey request_id, l_linenumber pos, l_partkey part, case when row_id is null then upper('p' || l_partkey) else asin end asin, case when row_id is null then 'seen' else title end title, l_extendedprice price, brand from lineitem left join catalog on row_id = l_partkey and l_partkey % 4 <> 1")
def candidates_from_visible(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    shown = F.when(F.col("l_partkey") % 4 != 1, F.col("l_partkey").cast("string")).otherwise(F.concat(F.lit(" p"), F.col("l_partkey").cast("string")))
    visible = li.select(F.col("l_orderkey").alias("request_id"), F.struct("l_linenumber", "l_partkey").alias("pos0"), F.col("l_linenumber").alias("pos"), F.col("l_partkey"), shown.alias("asin"), F.lit("seen").alias("title"), F.col("l_extendedprice").alias("price"))
    made = C.candidates_from_visible(visible, catalog(spark, d))
    c = F.col("candidate")
    part = F.regexp_replace(c["asin"], "^P", "").cast("bigint")
    return made.select("request_id", "pos", part.alias("part"), c["asin"].alias("asin"), c["title"].alias("title"), c["price"].alias("price"), c["brand"].alias("brand"))


def contexts_of(spark: SparkSession, d: str, picked: DataFrame) -> DataFrame:
    nothing = {"Rating": "string", "MainImage": "string", "instruction_text": "string", "Reviews": "array<struct<score:string,summary:string,body:string>>", "option_to_image": "map<string,string>", "instruction_attributes": "array<string>"}
    made = C.candidate_from_context(C.item_context(catalog(spark, d).withColumns({k: F.lit(None).cast(v) for k, v in nothing.items()}), picked))
    c = F.col("candidate")
    return made.select("selection_id", *(c[f].alias(f) for f in ("asin", "title", "price", "brand")))


@query(f"""with {CATALOG_SQL} select l_orderkey || '/' || l_partkey selection_id, case when l_orderkey % 3 = 0 then asin end asin, case when l_orderkey % 3 = 0 then title end title, case when l_orderkey % 3 = 0 then price end price, case when l_orderkey % 3 = 0 then brand end brand
 from (select distinct l_orderkey, l_partkey from lineitem) left join catalog on row_id = l_partkey""")
def item_context(spark: SparkSession, d: str) -> DataFrame:
    picked = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().select(F.concat_ws("/", "l_orderkey", "l_partkey").alias("selection_id"), F.col("l_partkey").cast("string").alias("selected_asin"), F.when(F.col("l_orderkey") % 3 == 0, "item").otherwise("results").alias("page_type"), F.create_map().cast("map<string,string>").alias("selected_options"))
    return contexts_of(spark, d, picked)


@query(f"""with {CATALOG_SQL}, lines as (select o_custkey, o_orderkey % 2 side, row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderkey, l_linenumber, l_partkey) pos, l_partkey from orders join lineitem on o_orderkey = l_orderkey),
 firsts as (select o_custkey, l_partkey, min(side * 1000000000 + pos) o from lines group by all)
 select o_custkey request_id, row_number() over (partition by o_custkey order by o) pos, asin from firsts join catalog on row_id = l_partkey""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    cat = C.candidate_items(catalog(spark, d), "row_id").select("row_id", "candidate")
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    place = F.row_number().over(W.partitionBy("request_id", "side").orderBy("o_orderkey", "l_linenumber", "l_partkey"))
    placed = lines.select(F.col("o_custkey").alias("request_id"), (F.col("o_orderkey") % 2).alias("side"), "o_orderkey", "l_linenumber", "l_partkey").withColumn("pos", place)
    rows = placed.join(cat, F.col("l_partkey") == F.col("row_id"))
    even, odd = (rows.where(F.col("side") == n).select("request_id", "pos", "candidate") for n in (0, 1))
    return C.merge_candidates(even, odd, 2**31 - 1).select("request_id", F.col("pos").cast("bigint").alias("pos"), F.col("candidate.asin").alias("asin"))


@query(f"with {CATALOG_SQL} select asin, title, category from catalog where category = 'economy' order by row_id limit 20")
def browse_category(spark: SparkSession, d: str) -> DataFrame:
    return C.browse(catalog(spark, d), "category", "economy", 20).select("asin", F.col("Title").alias("title"), "category")


@query(f"with {CATALOG_SQL} select l_orderkey request_id, l_linenumber line, l_partkey part, title, price from lineitem left join catalog on row_id = l_partkey")
def lookup_products(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("asin"))
    return C.lookup_products(li, catalog(spark, d)).select("request_id", "line", "part", F.col("product.title").alias("title"), F.col("product.price").alias("price"))


@query(CHECKS_SQL + " select request_id, part, coalesce(string_agg(field, ',' order by pos) filter (matched), '') satisfied, coalesce(string_agg(field, ',' order by pos) filter (known and not coalesce(matched, false)), '') violated from checks group by request_id, part")
def evaluate_constraints(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(spark, d).select("request_id", "part", F.array_join("satisfied", ",").alias("satisfied"), F.array_join("violated", ",").alias("violated"))


@query(CHECKS_SQL + """ select field, count(*) checks, count(*) filter (matched) satisfied, count(*) filter (known and not coalesce(matched, false)) violated, count(*) - count(*) filter (matched) - count(*) filter (known and not coalesce(matched, false)) "unknown", round(count(*) filter (matched) / count(*), 6) satisfied_rate, round(count(*) filter (known and not coalesce(matched, false)) / count(*), 6) violated_rate from checks group by 1""")
def constraint_rates(spark: SparkSession, d: str) -> DataFrame:
    return K.constraint_rates(evaluated(spark, d))


@query(f"with {WISHES_SQL} select request_id, concat_ws(',', case when w_category is not null then 'category' end, case when w_budget is not null then 'budget_max' end, case when w_brand is not null then 'brand' end, case when w_color is not null then 'color' end, case when w_size is not null then 'size' end, 'material') active, concat_ws(',', case when w_category is not null then 'category' end, case when w_color is not null then 'color' end, case when w_size is not null then 'size' end, case when w_brand is not null then 'brand' end) requested from wishes")
def active_constraints(spark: SparkSession, d: str) -> DataFrame:
    asked = F.transform(K.requested_constraints(F.col("constraints")), lambda c: c["field"])
    return wishes(spark, d).select("request_id", F.array_join(K.active_constraints(F.col("constraints")), ",").alias("active"), F.array_join(asked, ",").alias("requested"))


@query(CHECKS_SQL + """, per as (select request_id, part, bool_and(coalesce(matched, false)) filter (field in ('category','color','size','brand')) all_ok, count(*) filter (field in ('category','color','size','brand')) asked, coalesce(bool_and(coalesce(matched, false)) filter (field = 'category'), true) cat_ok, count(*) filter (field = 'size' and not coalesce(matched, false)) size_open from checks group by request_id, part)
 select request_id, part, coalesce(all_ok, false) and asked > 0 and request_id % 2 = 0 all_satisfied, size_open = 0 resolved, request_id % 2 = 0 and cat_ok and size_open = 0 ready from per""")
def page_readiness(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("candidate")
    page = evaluated(spark, d).withColumns({"page_type": F.when(F.col("request_id") % 2 == 0, "item").otherwise("results"), "selected_asin": c["asin"], "result_asin": F.lit(None).cast("string"), "title": c["title"], "price": c["price"], "category": c["category"], "brand": c["brand"], "item_title": F.lit(None).cast("string"), "item_price": F.lit(None).cast("double"), "options": c["options"]})
    return K.readiness(page).select("request_id", "part", "all_satisfied", "resolved", "ready")


@query(CHECKS_SQL + """, per as (select request_id, part, count(*) filter (matched) s, count(*) filter (known and not coalesce(matched, false)) v from checks group by request_id, part)
 select request_id, part, case when request_id % 5 = 0 then 'no_matching_results' when v > 0 and s > 0 then 'partial_constraint_failure' when v > 0 then 'constraint_mismatch' end reason from per""")
def feedback_reasons(spark: SparkSession, d: str) -> DataFrame:
    seen = evaluated(spark, d).withColumns({"raw_text": F.when(F.col("request_id") % 5 == 0, "Total results: 00").otherwise("Total results: 12"), "visible_items": F.array().cast("array<struct<asin:string>>")})
    return pages.reasons(seen).select("request_id", "part", "reason")


SEARCH_SQL = """with toks as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from documents where text is not null),
 counts as (select doc_id, len(t) length, unnest(t) term from toks), tf as (select term, doc_id, length, count(*) tf from counts group by all),
 dfs as (select term, count(*) df from tf group by 1), tot as (select count(*) n, avg(len(t)) m from toks),
 post as (select term, doc_id, cast(round(1000000 * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * length / m)))) as bigint) impact from tf join dfs using (term), tot),
 q as (select distinct item_id query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark),
 scored as (select query_id, doc_id, sum(impact) score from q join post using (term) group by all),
 ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from scored)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


@query(SEARCH_SQL + " select query_id, doc_id, cast(score as bigint) score, rank from ranked where rank <= 10")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_topk(asked, search.postings(corpus(spark, d)), 10).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(SEARCH_SQL + """, cell as (select query_id, doc_id // 16 block, term, max(impact) most from q join post using (term) group by all),
 bounds as (select query_id, block, sum(most) bound from cell group by all), best as (select query_id, block from bounds qualify row_number() over (partition by query_id order by bound desc, block) <= 16),
 floors as (select query_id, score floor_ from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) n from scored semi join best on best.query_id = scored.query_id and best.block = scored.doc_id // 16) where n = 10)
 select query_id, count(*) blocks, count(*) filter (bound >= coalesce(floor_, 0)) "read" from bounds left join floors using (query_id) group by 1""")
def search_blocks(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_blocks(asked, search.postings(corpus(spark, d)), 10)


@query(SEARCH_SQL + " select term, count(*) df, cast(sum(tf) as bigint) tf from tf group by 1")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.corpus_stats(corpus(spark, d))[0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


CATALOG_SEARCH_SQL = f"""with {CATALOG_SQL}, {WISHES_SQL}, toks as (select row_id doc_id, regexp_extract_all(lower(title || ' ' || p_type), '[a-z0-9]+') t from catalog),
 counts as (select doc_id, len(t) length, unnest(t) term from toks), tf as (select term, doc_id, length, count(*) tf from counts group by all),
 dfs as (select term, count(*) df from tf group by 1), tot as (select count(*) n, avg(len(t)) m from toks),
 post as (select term, doc_id, cast(round(1000000 * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * length / m)))) as bigint) impact from tf join dfs using (term), tot),
 q as (select distinct c_custkey query_id, unnest([lower(['ECONOMY','STANDARD','PROMO','SMALL','MEDIUM','LARGE'][c_custkey % 6 + 1]), ['red','blue','small','large','widget'][c_custkey % 5 + 1]]) term from customer),
 scored as (select query_id, doc_id, sum(impact) score from q join post using (term) group by all),
 ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from scored where true)"""


@query(CATALOG_SEARCH_SQL + """, tops as (select query_id, string_agg(cast(doc_id as varchar), ',' order by rank) found from ranked where rank <= 10 group by 1)
 select c_custkey request_id, case when c_custkey % 10 = 0 then 'error' else 'observed' end status, case when c_custkey % 10 = 0 then 'missing_gold_search_query' when found is null then 'no_matching_results' end reason, coalesce(found, '') found from customer left join tops on query_id = c_custkey and c_custkey % 10 <> 0""")
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    posted = search.postings(cat.select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "Title", F.upper("category")).alias("text")))
    asked = wishes(spark, d).withColumn("query", F.when(F.col("request_id") % 10 == 0, "  ").otherwise(F.col("query")))
    out = search.search_candidates(asked, posted, cat)
    return out.select("request_id", "status", "reason", F.coalesce(F.array_join(F.transform("candidates", lambda c: c["asin"]), ","), F.lit("")).alias("found"))


@query(f"with {RANKED_SQL} select request_id, pos, asin, original_rank, rerank_rank, decision from good")
def apply_rerank(spark: SparkSession, d: str) -> DataFrame:
    good, _ = rerank.apply_rerank(*ranked_lines(spark, d), top_k=4)
    return good.select("request_id", *(F.col(c).cast("bigint").alias(c) for c in ("pos", "original_rank", "rerank_rank")), "asin", "decision")


@query(f"with {RANKED_SQL} select * from results")
def rerank_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    out = rerank.rerank_or_fallback(*ranked_lines(spark, d), top_k=4)
    return out.select("request_id", *(F.col(c).cast("bigint").alias(c) for c in ("pos", "original_rank", "rerank_rank")), "asin", "fallback", "error")


@query(f"with {RANKED_SQL}, raw_ as (select request_id, count(*) n from cands group by 1), back as (select request_id, count(*) r, bool_or(fallback is not null) f, string_agg(asin || ':' || original_rank, ',' order by pos) ids from results group by 1) select request_id, n raw_candidate_count, coalesce(r, 0) returned_candidate_count, not coalesce(f, false) succeeded, coalesce(f, false) fallback_used, coalesce(ids, '') returned_ids from raw_ left join back using (request_id)")
def rerank_summary(spark: SparkSession, d: str) -> DataFrame:
    rows, cands = ranked_lines(spark, d)
    return rerank.rerank_summary(cands, rerank.rerank_or_fallback(rows, cands, top_k=4))


@query(f"with {RANKED_SQL} select request_id, count(*) items, round(avg(original_rank - rerank_rank), 6) mean_shift, max(original_rank - rerank_rank) max_shift, bool_or(rerank_rank = 1 and original_rank = 1) top_kept from good group by 1")
def rank_shift(spark: SparkSession, d: str) -> DataFrame:
    good, _ = rerank.apply_rerank(*ranked_lines(spark, d), top_k=4)
    return rerank.rank_shift(good).withColumn("max_shift", F.col("max_shift").cast("bigint"))


@query(f"with {RANKED_SQL} select request_id, place pos, asin from cands where place <= 3")
def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    return rerank.rerank_window(ranked_lines(spark, d)[1], top_n=3).select("request_id", F.col("pos").cast("bigint").alias("pos"), "asin")


@query(CATALOG_SEARCH_SQL + """, c as (select query_id, rank, doc_id, lower(p_type) t, title, price, w_category, w_budget, case when w_category is not null then contains(lower(p_type), case when length(w_category) > 3 and ends_with(w_category, 's') then w_category[:-2] else w_category end) or contains(lower(title), case when length(w_category) > 3 and ends_with(w_category, 's') then w_category[:-2] else w_category end) end fam from ranked join catalog on row_id = doc_id join wishes on request_id = query_id where rank <= 10)
 select query_id request_id, doc_id, rank original_rank, row_number() over (partition by query_id order by coalesce(fam, false) desc, coalesce(price > cast(w_budget as double), false), rank) rerank_rank from c qualify rerank_rank <= 5""")
def rule_rerank(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    posted = search.postings(cat.select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "Title", F.upper("category")).alias("text")))
    asked = wishes(spark, d)
    hits = search.search_topk(asked.select(F.col("request_id").alias("query_id"), "query"), posted, 10)
    found = hits.join(C.candidate_items(cat, "row_id").select("row_id", "candidate"), F.col("doc_id") == F.col("row_id")).join(asked.select("request_id", "constraints"), F.col("query_id") == F.col("request_id"))
    wish = lambda f: F.get(F.filter("constraints", lambda c: c["field"] == f), F.lit(0))["value"]
    family = K.match(candidate_result(), "category", wish("category"))[0]
    over = ~K.match(candidate_result(), "budget_max", wish("budget_max"))[0]
    rows = found.select("request_id", "doc_id", F.col("doc_id").cast("string").alias("asin"), F.col("rank").alias("original_rank"), family.alias("family"), over.alias("violates_latest"), F.array().cast("array<string>").alias("satisfied"))
    return rerank.rule_rerank(rows, 5).select("request_id", "doc_id", F.col("original_rank").cast("bigint").alias("original_rank"), F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


@query(CATALOG_SEARCH_SQL + """, top as (select query_id, doc_id from ranked where rank = 1) select query_id request_id, cast(doc_id as varchar) asin, concat_ws(',', case when w_budget is not null and price <= cast(w_budget as double) then 'budget_max' end, case when w_brand is not null and lower(brand) = w_brand then 'brand' end, case when w_color is not null and color = w_color then 'color' end) satisfied from top join catalog on row_id = doc_id join wishes on request_id = query_id""")
def refresh_constraints(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    posted = search.postings(cat.select(F.col("row_id").alias("doc_id"), F.concat_ws(" ", "Title", F.upper("category")).alias("text")))
    asked = wishes(spark, d).withColumn("constraints", F.filter("constraints", lambda c: c["field"] != "category"))
    hits = search.search_topk(asked.select(F.col("request_id").alias("query_id"), "query"), posted, 5)
    top = hits.join(C.candidate_items(cat, "row_id").select("row_id", "candidate"), F.col("doc_id") == F.col("row_id")).select(F.col("query_id").alias("request_id"), F.col("rank").alias("rerank_rank"), "candidate")
    return K.refresh_constraints(top, asked.select("request_id", "constraints")).select("request_id", "asin", F.array_join("satisfied", ",").alias("satisfied"))


STEP_KEYS = ("instance_id", "turn_id")


@query(f"with {STEPS_SQL} select instance_id, turn_id, step_index, state_changed, made_progress, repeat_streak, cast(stagnant_steps as bigint) stagnant_steps from s4")
def step_progress(spark: SparkSession, d: str) -> DataFrame:
    return judged_steps(spark, d).select(*STEP_KEYS, F.col("step_index").cast("bigint").alias("step_index"), "state_changed", "made_progress", F.col("repeat_streak").cast("bigint").alias("repeat_streak"), "stagnant_steps")


@query(f"with {STEPS_SQL} select instance_id, turn_id, step_index, action_type, stop_reason from stopped")
def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return steps.stop_reasons(judged_steps(spark, d)).select(*STEP_KEYS, F.col("step_index").cast("bigint").alias("step_index"), "action_type", "stop_reason")


@query(f"with {STEPS_SQL} select instance_id, turn_id, count(*) num_internal_steps, count(*) filter (action_type in ('search','refine')) num_search_actions, coalesce(string_agg(rawq, '|' order by step_index) filter (action_type in ('search','refine')), '') search_queries, arg_max(action_type, step_index) last_action, coalesce(arg_max(stop_reason, case when stop_reason is null then null else step_index end), 'step_budget') stop_reason from stopped group by all")
def turn_rollup(spark: SparkSession, d: str) -> DataFrame:
    return steps.turn_rollup(steps.stop_reasons(judged_steps(spark, d))).withColumn("search_queries", F.array_join("search_queries", "|"))


@query(f"with {STEPS_SQL} select instance_id, turn_id, step_index, coalesce(string_agg(action_type, ',') over (partition by instance_id, turn_id order by step_index rows between 6 preceding and 1 preceding), '') context from s0")
def step_context(spark: SparkSession, d: str) -> DataFrame:
    s = event_steps(spark, d).withColumn("candidates", F.array().cast("array<struct<asin:string,title:string,price:double>>"))
    return steps.step_context(s).select(*STEP_KEYS, F.col("step_index").cast("bigint").alias("step_index"), F.array_join(F.transform("context", lambda x: x["action_type"]), ",").alias("context"))


@query("select conv_id instance_id, turn turn_id, case when turn % 2 = 0 then 1 else 0 end num_search_actions, turn % 3 = 0 made_progress, 'direct_search' stop_reason from conversations")
def direct_trace(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("instance_id"), F.col("turn").alias("turn_id"), F.when(F.col("turn") % 2 == 0, "q").alias("query"), F.when(F.col("turn") % 3 == 0, F.array(F.lit(1))).alias("candidates"))
    return steps.direct_trace(rows).select(*STEP_KEYS, "num_search_actions", F.col("rollout_trace")[0]["made_progress"].alias("made_progress"), "stop_reason")


@query("select conv_id instance_id, turn turn_id, coalesce(last_value(case when turn % 3 = 0 then regexp_extract(text, '^\\S+') end ignore nulls) over (partition by conv_id order by turn), 'start') intention from conversations")
def carry_intention(spark: SparkSession, d: str) -> DataFrame:
    t = conversation_turns(spark, d)
    first = t.select("instance_id").distinct().withColumn("intention", F.lit("start"))
    return I.carry_intention(t.drop("intention"), first).select("instance_id", "turn_id", "intention")


@query(f"with {SHIFTS_SQL}, turns as (select distinct instance_id, turn_id from shifts), fields as (select distinct instance_id, field from given), best as (select t.instance_id, t.turn_id, f.field, max(g.turn_id) at_ from turns t join fields f using (instance_id) join given g on g.instance_id = t.instance_id and g.field = f.field and g.turn_id <= t.turn_id group by all) select b.instance_id, cast(b.turn_id as int) turn_id, b.field, g.value from best b join given g on g.instance_id = b.instance_id and g.field = b.field and g.turn_id = b.at_")
def fold_intentions(spark: SparkSession, d: str) -> DataFrame:
    return I.fold_intentions(*order_shifts(spark, d))


@query(f"with {SHIFTS_SQL}, r as (select *, lag(value) over (partition by instance_id, field order by turn_id) old from given) select instance_id, cast(turn_id as int) turn_id, field, op, old, value \"new\", rationale from r where op <> 'initial'")
def shift_deltas(spark: SparkSession, d: str) -> DataFrame:
    return I.shift_deltas(*order_shifts(spark, d))


# A field with a space never matches a known one again, so it loses its place in the order.
PRIORITY_SQL = f"""with recursive {SHIFTS_SQL},
 fold(instance_id, turn_id, f, old, new_, op) as (
  select c_custkey, cast(-1 as bigint), own, cast(null as varchar[]), own, 'none' from (select c_custkey, case when c_custkey % 2 = 0 then ['high', 'low'] else ['low'] end own from customer)
  union all
  select instance_id, turn_id, f, p, list_concat(named, list_filter(f, lambda x: not list_contains(named, x))), case when asked <> p then 'reprioritize' else 'none' end
  from (select *, list_filter(coalesce(asked, p), lambda x: not contains(x, ' ')) named
   from (select *, case when op = 'reprioritize' then case when list_contains(known, field) and not contains(field, ' ') then list_concat([field], list_filter(known, lambda x: x <> field)) else known end end asked
    from (select *, case when assigns and not list_contains(p, field) then list_append(p, field) else p end known
     from (select s.instance_id, s.turn_id, s.op, s.field, fold.new_ p, s.op in ('add','relax','override','scope_correction') assigns,
       case when s.op in ('add','relax','override','scope_correction') and not list_contains(fold.f, s.field) then list_append(fold.f, s.field) else fold.f end f
       from fold join shifts s on s.instance_id = fold.instance_id and s.turn_id = fold.turn_id + 1)))))"""


@query(PRIORITY_SQL + " select instance_id, cast(turn_id as int) turn_id, op, array_to_string(old, ',') \"old\", array_to_string(new_, ',') \"new\" from fold where turn_id >= 0")
def fold_priority(spark: SparkSession, d: str) -> DataFrame:
    first, made = order_shifts(spark, d)
    start = first.groupBy("instance_id").agg(F.array_sort(F.collect_list("field")).alias("fields"), F.array().cast("array<string>").alias("priority"))
    return I.fold_priority(start, made).select("instance_id", "turn_id", "op", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


@query(f"with {SHIFTS_SQL} select op, condition, field, count(*) shifts, grouping(op) * 4 + grouping(condition) * 2 + grouping(field) level from shifts group by cube (op, condition, field)")
def shift_distribution(spark: SparkSession, d: str) -> DataFrame:
    return I.shift_distribution(order_shifts(spark, d)[1])


@query("with t as (select conv_id, turn, regexp_extract(text, '^\\S+') i from conversations) select conv_id instance_id, turn turn_id, concat_ws('>', string_agg(i, '>') over (partition by conv_id order by turn rows between 4 preceding and 1 preceding), i || '*') timeline from t")
def intention_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = I.intention_timeline(conversation_turns(spark, d))
    shown = F.transform("timeline", lambda x: F.concat(x["gold_intention"], F.when(x["is_current"], "*").otherwise("")))
    return rows.select("instance_id", "turn_id", F.array_join(shown, ">").alias("timeline"))


@query(rf"with t as (select conv_id, turn, role, regexp_replace(text, '^{SP}|{SP}$', '', 'g') said from conversations), h as (select *, list(said) filter (role = 'user' and said <> '') over (partition by conv_id order by turn) seen from t), a as (select conv_id, turn, case when said <> '' and (seen is null or len(seen) = 0 or seen[-1] <> said) then list_append(coalesce(seen, []), said) else coalesce(seen, []) end all_ from h) select conv_id instance_id, turn turn_id, len(all_[greatest(1, len(all_) - 7):]) n, md5(array_to_string(all_[greatest(1, len(all_) - 7):], '|')) digest from a")
def utterance_context(spark: SparkSession, d: str) -> DataFrame:
    rows = I.utterance_context(conversation_turns(spark, d).withColumn("current", F.col("text")))
    return rows.select("instance_id", "turn_id", F.size("context").cast("bigint").alias("n"), F.md5(F.array_join("context", "|").cast("binary")).alias("digest"))


@query("with t as (select conv_id, turn, role = 'assistant' and turn >= 3 done from conversations where turn <= 5), e as (select *, max(done) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) ended from t) select conv_id instance_id, turn turn_id from e where not coalesce(ended, false)")
def truncate_dialogues(spark: SparkSession, d: str) -> DataFrame:
    t = conversation_turns(spark, d).withColumn("done", (F.col("role") == "assistant") & (F.col("turn_id") >= 3))
    return I.truncate_dialogues(t, 5).select("instance_id", "turn_id")


@query("select conv_id instance_id, count(*) turns, arg_min(regexp_extract(text, '^\\S+'), turn) first_intention, arg_max(regexp_extract(text, '^\\S+'), turn) last_intention, md5(string_agg(text, '|' order by turn)) utterances from conversations group by 1")
def instance_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = conversation_turns(spark, d).withColumn("utterance", F.col("text"))
    return I.instance_rollup(t).withColumn("utterances", F.md5(F.array_join("utterances", "|").cast("binary")))


@query(f"with {SHIFTS_SQL}, turns as (select distinct instance_id, turn_id from shifts), fields as (select distinct instance_id, field from given), best as (select t.instance_id, t.turn_id, f.field, max(g.turn_id) at_ from turns t join fields f using (instance_id) join given g on g.instance_id = t.instance_id and g.field = f.field and g.turn_id <= t.turn_id group by all), made as (select b.*, g.value from best b join given g on g.instance_id = b.instance_id and g.field = b.field and g.turn_id = b.at_) select instance_id, count(*) fields, count(*) filter (field <> 'low' or turn_id % 2 = 0 or value is null) agreeing from made group by 1")
def validate_deltas(spark: SparkSession, d: str) -> DataFrame:
    first, made = order_shifts(spark, d)
    # Recorded state that differs from the fold in every second turn's `low`.
    held = I.fold_intentions(first, made).withColumn("value", F.when((F.col("field") == "low") & (F.col("turn_id") % 2 != 0), F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return I.validate_deltas(first, made, held).groupBy("instance_id").agg(F.count("*").alias("fields"), F.count_if("agrees").alias("agreeing"))


# Old values of all five kinds, bounds and others, beside what a model may say.
@query("""with c as (select c_custkey k, case when c_custkey % 7 = 0 then 'budget_max' when c_custkey % 7 = 1 then 'price_min' else 'size' end field, ['boolean', 'int', 'float', 'text', 'none'][c_custkey % 5 + 1] kind, c_custkey % 8 v from customer),
 said as (select *, [null, 5.0, 9.5, null, null, 3.0, null, 0.0][v + 1]::double n, ['"yes"', '"5.0"', '" 9.50 "', '"many"', '" None"', '3', '"No"', '"0"'][v + 1] raw, ['"yes"', '"5.0"', '"9.50"', '"many"', null, '3', '"No"', '"0"'][v + 1] plain from c),
 made as (select *, case when v = 4 then null when kind = 'boolean' then case when v in (6, 7) then 'false' else 'true' end when kind = 'int' then case when n is null then raw when n = floor(n) then cast(cast(n as bigint) as varchar) else cast(n as varchar) end
   when kind = 'float' or field <> 'size' then coalesce(cast(n as varchar), raw) else plain end made,
   case when field = 'budget_max' then [1.25, 8.75, 37.5, null, null][k % 5 + 1] when field = 'price_min' then [0.8, 5.6, 24.0, null, null][k % 5 + 1] end loose from said)
 select k id, kind, made, cast(loose as double) loose from made""")
def coerce_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    of = lambda m, *texts: F.element_at(F.array(*map(F.lit, texts)), (k % m + 1).cast("int"))
    field = F.when(k % 7 == 0, "budget_max").when(k % 7 == 1, "price_min").otherwise("size")
    old = F.parse_json(of(5, "true", "7", "30.0", '"9.50"', "null"))
    value = F.parse_json(of(8, '"yes"', '"5.0"', '" 9.50 "', '"many"', '" None"', "3", '"No"', '"0"'))
    rows = table(spark, d, "customer").select(k.alias("id"), field.alias("field"), old.alias("old"), value.alias("value"))
    f = F.col("field")
    return rows.select("id", S.variant_kind(F.col("old")).alias("kind"), F.to_json(S.coerce_variant(f, F.col("value"), F.col("old"))).alias("made"), F.try_variant_get(S.relax_variant(f, F.col("old")), "$", "double").alias("loose"))


# What is inferred about a change, the loosened value, how it is to be said, and the evidence that is kept of it.
@query("""with o as (select o_orderkey k, ['refine it', 'Suddenly bored', 'Unavailable now', 'too coarse', 'plain', ''][o_orderkey % 6 + 1] why, o_orderkey % 4 = 0 moves, [null, 'red', '30'][o_orderkey % 3 + 1] old, [null, 'red', null, '40', null][o_orderkey % 5 + 1] new_,
   case o_orderkey % 7 when 0 then null when 1 then 'budget_max' when 2 then 'price_min' else 'size' end field from orders),
 c as (select *, case when moves then 'reprioritize' when why = 'refine it' then 'scope_correction' when old is not null and new_ is not null and old <> new_ then 'override' when old is not null and new_ is null then 'relax' when field is not null and old is null and new_ is not null then 'add' else 'none' end category from o),
 e as (select *, case when category = 'scope_correction' then 'agent_misunderstanding' when why = 'Suddenly bored' then 'user_preference' when why = 'Unavailable now' then 'real_world_feasibility' when why = 'too coarse' then 'agent_misunderstanding' else 'user_preference' end condition, category <> 'none' changed from c)
 select k id, category, condition, case when old = '30' then case field when 'budget_max' then '37.5' when 'price_min' then '24' end end loose, ['explicit', 'partial', 'partial', 'partial'][k % 4 + 1] || '/' || ['indirect', 'direct', 'direct'][k % 3 + 1] || '/' || (k % 2 = 0)::varchar plan,
  case when changed then condition end cause, case when changed then why end reason, case when changed then category || '/' || coalesce(field, '-') || '/' || coalesce(old, '-') || '/' || coalesce(new_, '-') || '/' || case when moves then 'a' else '' end end details,
  case when changed then condition else 'none' end "trigger", case when changed then coalesce(field, '-') || '/' || why end trigger_details from e""")
def shift_inferences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    of = lambda m, *texts: F.element_at(F.array(*(F.lit(x).cast("string") for x in texts)), (k % m + 1).cast("int"))
    rows = table(spark, d, "orders").select(
        k.alias("id"),
        of(6, "refine it", "Suddenly bored", "Unavailable now", "too coarse", "plain", "").alias("why"),
        F.when(k % 4 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("update"),
        of(3, None, "red", "30").alias("old"),
        of(5, None, "red", "None", "40", " ").alias("value"),
        of(7, None, "budget_max", "price_min", "size", "size", "size", "size").alias("field"),
        S.utterance_plan(of(4, "EXPLICIT ", "partial", "weird", None), of(3, "Indirect", "direct", None), F.when(k % 2 == 0, True)).alias("plan"),
    )
    rows = rows.withColumn("category", S.infer_category(F.col("update"), F.col("why"), F.col("field"), F.col("old"), F.col("value")))
    rows = rows.withColumns({"condition": S.infer_condition(F.col("category"), F.col("why")), "new": T.none_like(F.col("value")), "changed": F.col("category") != "none"})
    rows = rows.withColumn("e", S.shift_evidence(*map(F.col, ("changed", "condition", "category", "category", "field", "old", "new", "update", "why"))))
    cause, trigger, dash = F.col("e.shift_condition"), F.col("e.trigger_evidence"), lambda c: F.coalesce(c, F.lit("-"))
    of_cause, of_trigger = cause["details"], trigger["details"]
    details = F.concat_ws("/", of_cause["op"], dash(of_cause["field"]), dash(of_cause["old_value"]), dash(of_cause["value"]), F.array_join(of_cause["priority_update"], ","))
    return rows.select(
        "id",
        "category",
        "condition",
        S.relax_value(dash(F.col("field")), F.col("old")).alias("loose"),
        F.concat_ws("/", "plan.style", "plan.directness", F.col("plan.mention_old_value").cast("string")).alias("plan"),
        cause["type"].alias("cause"),
        cause["reason"].alias("reason"),
        F.when(cause.isNotNull(), details).alias("details"),
        trigger["trigger_type"].alias("trigger"),
        F.when(of_trigger.isNotNull(), F.concat_ws("/", dash(of_trigger["field"]), of_trigger["rationale"])).alias("trigger_details"),
    )


# Recorded dialogues with a fault planted in one part of every third turn: a value, the order of wishes, the priority or an old value.
@query(PRIORITY_SQL + """ select instance_id, count(*) turns, count(*) filter (fault = 1) bad_constraints, count(*) filter (fault = 2 and len(f) > 1) bad_order, count(*) filter (fault = 3 and len(new_) > 1) bad_priority, count(*) filter (fault = 4 and changes) bad_olds
 from (select fold.*, case when fold.turn_id % 3 = 1 then fold.instance_id % 5 end fault, coalesce(s.op in ('add','relax','override','scope_correction'), false) changes from fold join shifts s using (instance_id, turn_id)) group by 1""")
def audit_trajectories(spark: SparkSession, d: str) -> DataFrame:
    first, made = order_shifts(spark, d)
    since = I.assignments(first, made).groupBy("instance_id", "field").agg(F.min("turn_id").alias("since"))
    held = I.fold_intentions(first, made).join(since, ["instance_id", "field"])
    key, planted = F.col("instance_id"), F.col("turn_id") % 3 == 1
    fault = lambda n: planted & (key % 5 == n)
    listed = F.array_sort(F.collect_list(F.struct("since", "field", "value")))
    wishes = held.groupBy("instance_id", "turn_id").agg(listed.alias("own"))
    wishes = wishes.withColumn("own", F.when(fault(1), F.transform("own", lambda e, i: F.when(i == 0, e.withField("value", F.lit("another"))).otherwise(e))).when(fault(2), F.reverse("own")).otherwise(F.col("own")))
    wishes = wishes.select("instance_id", "turn_id", F.to_json(F.map_from_entries(F.transform("own", lambda e: F.struct(e["field"], e["value"])))).alias("constraints"))
    start = first.groupBy("instance_id").agg(F.array_sort(F.collect_list("field")).alias("fields"), F.array().cast("array<string>").alias("priority"))
    order = I.fold_priority(start, made)
    entry = lambda op, old, new, why: F.struct(op.alias("op"), old.alias("old"), new.alias("new"), why.alias("rationale"))
    none = F.lit(None).cast("string")
    deltas = I.shift_deltas(first, made).select("instance_id", "turn_id", "field", entry(F.col("op"), F.when(fault(4), F.concat(F.coalesce("old", F.lit("")), F.lit("x"))).otherwise(F.col("old")), F.col("new"), F.col("rationale")).alias("entry"))
    moved = order.where("op = 'reprioritize'").select("instance_id", "turn_id", F.lit("priority").alias("field"), entry(F.col("op"), F.to_json("old"), F.to_json("new"), none).alias("entry"))
    maps = deltas.unionByName(moved).groupBy("instance_id", "turn_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "entry"))).alias("gold_delta"))
    shown = F.when(fault(3), F.reverse("new")).otherwise(F.col("new"))
    turns = order.select("instance_id", "turn_id", shown.alias("priority")).join(wishes, ["instance_id", "turn_id"]).join(maps, ["instance_id", "turn_id"], "left")
    turn = F.struct("turn_id", "gold_delta", F.struct("constraints", "priority").alias("gold_current_intention"))
    begin = first.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("own"))
    begin = begin.select("instance_id", F.struct(F.to_json(F.map_from_entries("own")).alias("constraints"), F.array().cast("array<string>").alias("priority")).alias("initial_intention"))
    audited = I.audit_trajectories(turns.groupBy("instance_id").agg(F.collect_list(turn).alias("turns")).join(begin, "instance_id"))
    return audited.groupBy("instance_id").agg(F.count("*").alias("turns"), *(F.count_if(~F.col(f"{c}_agree")).alias(f"bad_{c}") for c in ("constraints", "order", "priority", "olds")))


@query(f"with {SHIFTS_SQL} select instance_id, turn_id, case op when 'none' then 'Let''s keep looking.' when 'relax' then case turn_id % 3 when 0 then 'It doesn''t have to be exactly ' || replace(field, '_', ' ') || '.' when 1 then replace(field, '_', ' ') || ' can be a bit flexible.' else 'Close is fine.' end when 'add' then case turn_id % 3 when 0 then 'Also, I''d prefer ' || field || ' ' || value || '.' when 1 then 'Also, ' || value || ' would be nice.' else value || ' too.' end when 'override' then case turn_id % 3 when 0 then 'Actually, make it ' || value || ' instead.' when 1 then 'Let''s go with ' || value || ' instead.' else value || ' instead.' end else case turn_id % 3 when 0 then upper(field[1]) || field[2:] || ' matters more now.' when 1 then 'Focus more on ' || field || '.' else field || ' first.' end end utterance from shifts")
def fallback_utterances(spark: SparkSession, d: str) -> DataFrame:
    made = order_shifts(spark, d)[1]
    style = F.element_at(F.array(*map(F.lit, S.STYLES)), (F.col("turn_id") % 3 + 1).cast("int"))
    said = S.fallback_utterance(F.col("op"), F.col("field"), F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("string"), style, F.lit(False))
    return made.select("instance_id", F.col("turn_id").cast("bigint").alias("turn_id"), said.alias("utterance"))


# What is left of raw shifts: a new field is an addition, which needs a value, as a known field's needs that it had none.
NORMAL_SQL = f"""with {SHIFTS_SQL},
 n0 as (select *, replace(field, ' ', '_') name, case when field = 'low' then '1' end held, coalesce(field = 'low' or (field = 'high' and instance_id % 2 = 0), false) known from shifts),
 n1 as (select *, op <> 'none' changed, case when op not in ('none', 'reprioritize') and not known then 'add' else op end op4, case when instance_id % 2 = 0 then ['high', 'low'] else ['low'] end fields from n0),
 n2 as (select *, turn_id % 17 = 0 or (op4 = 'add' and known and held is not null) or (op4 in ('add', 'override') and value is null) invalid from n1),
 n3 as (select *, changed and not invalid live, changed and not invalid and op4 <> 'reprioritize' assigned from n2),
 normal as (select instance_id, cast(turn_id as int) turn_id, case when live then op4 else 'none' end op, live intention_changed, case when live then condition else 'none' end condition, case when live then op4 else 'none' end change_category, case when live then name end field,
  case when assigned and known then held end old_value, case when assigned then value end "value", case when invalid then 'invalid_llm_output' else rationale end rationale,
  case when not invalid and op4 = 'reprioritize' then array_to_string(case when known then list_concat([field], list_filter(fields, lambda x: x <> field)) else fields end, ',') end priority_update,
  case when not invalid and (not changed or op4 = 'reprioritize') then 'anything' end gold_search_query from n3)"""


@query(NORMAL_SQL + " select *, condition \"trigger\" from normal")
def normalize_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw model output: odd spellings, unknown fields and missing values among them."""
    out = I.normalize_shifts(raw_shifts(spark, d))
    evidence = S.shift_evidence(F.col("intention_changed"), F.col("condition"), F.col("change_category"), F.col("op"), F.col("field"), F.col("old_value"), F.col("value"), F.col("priority_update"), F.col("rationale"))
    return out.withColumn("trigger", evidence["trigger_evidence"]["trigger_type"]).withColumn("priority_update", F.array_join("priority_update", ",")).drop("utterance_plan")


@query(f"with {LOG_SQL} select event_id, caller_id, cast(session as bigint) session, event from lg")
def sessionize_log(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).select("event_id", "caller_id", "session", "event")


PAIRS_SQL = f"with {LOG_SQL}, done as (select caller_id, session, request_count, min(ts) done_ts, arg_min(event, ts) outcome from lg where event in ('success','fallback') group by all), pairs as (select a.caller_id, a.session, a.request_count, a.ts asked_ts, outcome, round(done_ts - a.ts, 6) latency from lg a left join done d on a.caller_id = d.caller_id and a.session = d.session and a.request_count = d.request_count where a.event = 'request')"


@query(PAIRS_SQL + " select caller_id, cast(session as bigint) session, request_count, round(asked_ts, 3) asked, outcome, round(latency, 3) latency from pairs")
def pair_log_calls(spark: SparkSession, d: str) -> DataFrame:
    return logs.pair_log_calls(sessions(spark, d)).select("caller_id", "session", "request_count", F.round("asked_ts", 3).alias("asked"), "outcome", F.round("latency", 3).alias("latency"))


@query(PAIRS_SQL + ", c as (select caller_id, session, count(*) filter (event = 'request') requests, count(*) filter (event = 'success') successes, count(*) filter (event = 'fallback') fallbacks, count(*) filter (event = 'cache_hit') cache_hits, sum(tokens) tokens from lg group by all), p as (select caller_id, session, avg(latency) m, quantile_cont(latency, 0.5) h, quantile_cont(latency, 0.95) p95 from pairs where outcome = 'success' group by all) select c.caller_id, cast(c.session as bigint) session, requests, successes, fallbacks, cache_hits, cast(tokens as bigint) tokens, round(m, 3) mean_latency, round(h, 3) median_latency, cast(floor(p95) as bigint) p95_seconds, round(cache_hits / nullif(cache_hits + requests, 0), 6) hit_ratio from c left join p on p.caller_id = c.caller_id and p.session = c.session")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_summary(sessions(spark, d)).select("caller_id", "session", "requests", "successes", "fallbacks", "cache_hits", "tokens", F.round("mean_latency", 3).alias("mean_latency"), F.round("median_latency", 3).alias("median_latency"), F.floor("p95_latency").alias("p95_seconds"), "hit_ratio")


# Sketches are approximate, so a row tells whether the rank of each quantile is right to 2 in 100, and to one call.
@query(PAIRS_SQL + " select caller_id, count(*) calls, true q50_near, true q95_near from pairs where outcome = 'success' group by 1 union all select null, count(*), true, true from pairs where outcome = 'success'")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    pairs = scratch_stored(logs.pair_log_calls(sessions(spark, d)))
    hours = scratch_stored(logs.latency_sketches(pairs))
    done = pairs.where("outcome = 'success'").select("caller_id", "latency")

    def near(c: str, q: float):
        slack = F.lit(0.02) + 1 / F.first("calls")
        return (F.avg((F.col("latency") < F.col(c)).cast("int")) <= q + slack) & (F.avg((F.col("latency") <= F.col(c)).cast("int")) >= q - slack)

    each = done.join(logs.latency_quantiles(hours, keys=("caller_id",)), "caller_id")
    all_ = done.drop("caller_id").crossJoin(logs.latency_quantiles(hours)).withColumn("caller_id", F.lit(None).cast("bigint"))  # with one row
    return each.unionByName(all_).groupBy("caller_id").agg(F.first("calls").alias("calls"), near("q50", 0.5).alias("q50_near"), near("q95", 0.95).alias("q95_near"))


@query(f"""with {LOG_SQL}, merged as (select query, k, ts, event_id, event, case when event = 'success' and caller_id % 2 = 0 then event_id end answer from lg where event in ('request', 'success')),
 held as (select *, last_value(answer ignore nulls) over (partition by query, k order by ts, event_id rows between unbounded preceding and 1 preceding) got from merged)
 select event_id, query, cast(k as bigint) k, got is not null hit, query || '!' || got response from held where event = 'request'""")
def cached_responses(spark: SparkSession, d: str) -> DataFrame:
    log = call_log(spark, d)
    prompts = log.where("event = 'request'").select("query", "k", "ts", "event_id")
    cache = log.where("event = 'success' and caller_id % 2 = 0").select("query", "k", "ts", "event_id", F.concat("query", F.lit("!"), F.col("event_id").cast("string")).alias("response"))
    hits, _ = logs.cached_responses(prompts, cache)
    found = prompts.join(hits.select("event_id", "response"), "event_id", "left")
    return found.select("event_id", "query", F.col("k").cast("bigint").alias("k"), F.col("response").isNotNull().alias("hit"), "response")


@query("""select page_id, case when contains(lower(html), 'buy now') or contains(lower(html), 'product details') or contains(lower(html), 'item page') then 'item' when contains(lower(html), 'results') or contains(lower(html), 'page 1') or contains(lower(html), 'back to search') then 'results' when contains(lower(html), 'instruction:') and contains(lower(html), 'search') then 'search' else 'unknown' end page_type, contains(lower(html), 'no results') or contains(lower(html), 'did not match any products') no_results, try_cast(nullif(regexp_extract(html, '\\$([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) shown_price from pages""")
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.classify_pages(table(spark, d, "pages"), "html").select("page_id", "page_type", "no_results", "shown_price")


@query(f"""with {RANKED_SQL} select request_id, string_agg(asin, ',' order by place) asins, count(*) items from (select request_id, place, lpad(asin, 10, '0') asin from cands) group by 1""")
def visible_items(spark: SparkSession, d: str) -> DataFrame:
    """Result pages written from candidates, and read back."""
    shown = ranked_lines(spark, d)[1].groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "asin"))), lambda c: F.concat(F.lpad(c["asin"], 10, "0"), F.lit(" [SEP] a title [SEP] $"), c["place"].cast("string"))), " [SEP] ").alias("items"))
    raw = shown.select("request_id", F.concat(F.lit("Instruction: [SEP] x [SEP] Back to Search [SEP] Page 1 (Total results: 5) [SEP] "), "items").alias("raw_text"), F.array(F.lit("back to search")).alias("clickables"), F.lit(False).alias("done"), F.lit(None).cast("struct<asin:string,title:string,price:double,pricing:array<double>,query:string,category:string,product_category:string,description:string,bullet_points:array<string>,attributes:array<string>,options:map<string,array<string>>,brand:string,color:string,rating:string>").alias("item_context"))
    out = pages.normalize_pages(raw)
    return out.select("request_id", F.array_join(F.transform("visible_items", lambda v: v["asin"]), ",").alias("asins"), F.size("visible_items").cast("bigint").alias("items"))


@query("""with e as (select event_id, event_type, cast(json_extract(props, '$.k') as int) k from events) select event_id, case when event_type = 'view' then 'search' when event_type = 'click' and k % 2 = 0 then 'click' when event_type = 'purchase' and k % 3 = 0 then 'buy' end action, case when event_type = 'view' then 'search' when event_type = 'click' and k % 2 = 0 then 'click' when k % 3 = 0 then 'buy' else 'search' end next_action from e""")
def validate_actions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    raw = e.select("event_id", F.when(F.col("event_type") == "view", " Search_Results").when(F.col("event_type") == "click", "OPEN").when(F.col("event_type") == "purchase", "purchase").otherwise("jump").alias("action_type"), F.create_map(F.lit("query"), F.lit(" x "), F.lit("target"), F.when(F.col("k") % 2 == 0, "A1").otherwise("Buy Now")).alias("payload"), F.array(F.lit("a1"), F.lit("buy now")).alias("clickables"), F.when(F.col("k") % 3 == 0, "item").otherwise("search").alias("page_type"), F.lit("red shoe").alias("utterance"), F.array().cast("array<struct<asin:string,title:string,click_target:string>>").alias("visible_items"), F.create_map(F.lit("Color"), F.array(F.lit("Blue"))).alias("options"), F.create_map().cast("map<string,string>").alias("selected_options"))
    out = pages.fallback_actions(pages.validate_actions(raw))
    return out.select("event_id", F.col("action.action_type").alias("action"), F.col("next_action.action_type").alias("next_action"))


@query("select p_partkey part, regexp_replace(lower(trim(p_name)), '  +', ' ', 'g') normal, p_retailprice price, case when p_partkey % 2 = 0 then cast(floor(p_retailprice) as double) end parsed, case when p_partkey % 3 = 0 then null else p_name end cleaned, length(cast(1000000000 + p_partkey as varchar)) = 10 is_id from part")
def text_columns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("  "))
    tag = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("costs $"), F.floor("p_retailprice").cast("string"), F.lit(",00"))).otherwise("free")
    return p.select(F.col("p_partkey").alias("part"), T.norm_text(raw).alias("normal"), F.col("p_retailprice").alias("price"), T.parse_price(tag).alias("parsed"), T.clean_query(F.when(F.col("p_partkey") % 3 == 0, " None ").otherwise(F.col("p_name"))).alias("cleaned"), T.is_asin((F.lit(1000000000) + F.col("p_partkey")).cast("string")).alias("is_id"))


@query("select c_custkey id, case when c_custkey % 4 = 0 then null else c_custkey end number from customer")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    """Model output of four forms around one object: fenced, plain, with talk, and broken."""
    key = F.col("c_custkey")
    body = F.concat(F.lit('{"n": '), key.cast("string"), F.lit("}"))
    raw = F.when(key % 4 == 0, F.concat(body, F.lit(" } and {"))).when(key % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key % 4 == 2, body).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" there.")))
    return table(spark, d, "customer").select(key.alias("id"), F.get_json_object(T.extract_json(raw), "$.n").cast("bigint").alias("number"))


class Echo:
    """A stand-in for a model: it answers with the prompt's length."""

    def generate(self, prompt: str) -> str:
        return str(len(prompt))


@query("select conv_id, turn, cast(length(text) as varchar) output, cast(null as varchar) error from conversations")
def bulk_generate(spark: SparkSession, d: str) -> DataFrame:
    return bulk.bulk_generate(table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt")), Echo).drop("prompt")


class FixedOrder:
    """A stand-in that puts two candidates of a prompt first, or talks nonsense."""

    def generate(self, prompt: str) -> str:
        import json

        items = json.loads(prompt.partition("\n\n")[2])["candidate_items"]
        if len(items) % 5 == 0:
            return "I can't."
        return json.dumps({"reranked_candidates": [{"asin": c["asin"], "new_rank": i + 1} for i, c in enumerate(reversed(items[-2:]))]})


@query(f"""with {RANKED_SQL}, c as (select request_id, place, asin, count(*) over (partition by request_id) n from cands)
 select request_id, case when n % 5 = 0 then place else n + 1 - place end pos, asin, case when n % 5 = 0 then 'bm25_top10' end fallback from c where case when n % 5 = 0 then place <= 10 else place > n - 2 end""")
def bulk_rerank(spark: SparkSession, d: str) -> DataFrame:
    cands = ranked_lines(spark, d)[1]
    part = cands.withColumn("row_id", F.substring("asin", 2, 20).cast("bigint")).join(C.candidate_items(catalog(spark, d), "row_id").select("row_id", "candidate"), "row_id", "left")
    item = F.col("candidate").withField("asin", F.col("asin")).withField("rank", F.col("place"))
    rows = part.select("request_id", "place", item.alias("candidate"))
    intents = cands.select("request_id").distinct().withColumns({"intention": F.lit('{"constraints": {}}'), "delta": F.lit("{}")})
    known = rows.where("candidate is not null").select("request_id", "place", "candidate")
    return bulk.bulk_rerank(known, intents, FixedOrder).select("request_id", F.col("pos").cast("bigint").alias("pos"), "asin", "fallback")


@query("""with t as (select conv_id, turn, role, text, length(text) n from conversations)
 select conv_id instance_id, count(*) turns, round(avg(case when turn % 2 = 0 then 1 else 0 end), 6) same_action, round(avg(case when n % 3 > 0 then 1 else 0 end), 6) same_stop_reason, round(avg(case when n % 5 = 0 or turn % 2 = 0 then 1 else 0 end), 6) same_query, round(avg(case when n % 7 < 4 then 1 else 0 end), 6) same_first_asin from t group by 1""")
def replay_agreement(spark: SparkSession, d: str) -> DataFrame:
    t, n = conversation_turns(spark, d), F.length("text")
    style = {"linguistic_style": F.lit(None).cast("string"), "action_implication": F.lit(None).cast("string")}
    # A recorded query is missing in every fifth length, and so is the replayed one.
    gold = t.select("instance_id", "turn_id", F.col("role").alias("action"), F.lit("direct_search").alias("stop_reason"), F.when(n % 5 > 0, F.col("text")).alias("query"), (n % 7).cast("string").alias("first_asin"), n.alias("size")).withColumns(style)
    odd = F.col("turn_id") % 2 != 0
    again = gold.withColumns({"action": F.when(odd, "other").otherwise(F.col("action")), "stop_reason": F.when(F.col("size") % 3 > 0, F.col("stop_reason")), "query": F.when(odd, F.concat("query", F.lit(" more"))).otherwise(F.col("query")), "first_asin": F.least("first_asin", F.lit("3"))})
    return bulk.replay_agreement(bulk.align_replay(gold.drop("size"), again))


@query("select o_custkey instance_id, count(*) n from orders where o_custkey in (select c_custkey from customer) group by 1")
def select_instances(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("task_index"))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("instance_id")).join(o, "instance_id", "left_semi")
    return readers.select_instances(o, ids).groupBy("instance_id").agg(F.count("*").alias("n"))


@query("with last_ as (select o_custkey k, max(o_orderkey) task_index from orders group by 1) select k instance_id, task_index, row_number() over (order by k desc) ordinal from last_ where k in (select c_custkey from customer)")
def select_instances_in_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("task_index"))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("instance_id")).join(o, "instance_id", "left_semi")
    # The largest id first: an id's place is the number of ids from it on.
    top = ids.agg(F.max("instance_id").alias("top"))
    asked = ids.crossJoin(top).select("instance_id", (F.col("top") - F.col("instance_id")).alias("ordinal"))  # with one row
    found = readers.select_instances(o, asked, keep_order=True)
    place = F.row_number().over(W.orderBy("ordinal")).cast("bigint")
    return found.select("instance_id", "task_index", place.alias("ordinal"))


@query("select distinct o_custkey instance_id from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"))
    return readers.missing_ids(ids, table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("instance_id")))


@query(f"""with {CATALOG_SQL}, {WISHES_SQL}, {OWNED_SQL}, p as (select request_id, part, title, price, brand, color, category, product_category from pairs)
 select request_id, part, title, price, case when request_id % 3 = 0 then 'Acme' else brand end brand, case when request_id % 2 = 0 then 'teal' else color end color, coalesce(product_category, category) base_category from p""")
def extract_result(spark: SparkSession, d: str) -> DataFrame:
    c, key = F.col("candidate"), F.col("request_id")
    context = c.withField("rating", F.lit(None).cast("string")).withField("selected_options", F.lit(None).cast("map<string,string>"))
    options = F.when(key % 6 == 0, F.create_map(F.lit(" COLOR"), F.lit("teal"), F.lit("brand"), F.lit("Acme"))).when(key % 2 == 0, F.create_map(F.lit("Color "), F.lit(" teal"))).when(key % 3 == 0, F.create_map(F.lit("Brand"), F.lit("Acme"))).otherwise(F.create_map().cast("map<string,string>"))
    page = pairs(spark, d).select("request_id", "part", context.alias("item_context"), F.struct(c["title"].alias("title"), F.lit(None).cast("double").alias("price")).alias("selected_item"), options.alias("selected_options"), F.lit("").alias("raw_text"))
    r = F.col("result")
    return K.extract_result(page).select("request_id", "part", *(r[f].alias(f) for f in ("title", "price", "brand", "color", "base_category")))


# Streams ----------------------------------------------------------------------------------
# Each query writes a table's view as files, reads them as a stream until none is left, and
# gives the collected output, so that it can be compared with the batch form.


def drained(spark: SparkSession, source: DataFrame, job, mode: str = "append", watch=None) -> DataFrame:
    """What job makes of source as a stream of files; files and state are in the shared folder.

    A column `slice` deals the rows out: those of each number come in a run of their own, in order, and the query is
    started again from its checkpoint. watch gets the query after each run.
    """
    root = scratch_path(spark)

    def run(out: DataFrame) -> None:
        writer = out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        if mode == "append":
            started = writer.format("parquet").option("path", f"{root}/out").start()
        else:
            started = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).start()
        started.awaitTermination()
        if watch:
            watch(started)

    if "slice" in source.columns:
        source.write.partitionBy("slice").parquet(f"{root}/dealt")
        dealt = spark.read.schema(source.schema).parquet(f"{root}/dealt")
        parts = [dealt.where(F.col("slice") == n).drop("slice") for (n,) in sorted(dealt.select("slice").distinct().collect())]
    else:
        parts = [source]
    store = streams.use_rocksdb(spark)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{root}/in")
            out = job(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
            run(out)
    finally:
        name = "spark.sql.streaming.stateStore.providerClass"
        spark.conf.unset(name) if store is None else spark.conf.set(name, store)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def out_of_order(rows: DataFrame, days: int, jitter: int, key: str) -> DataFrame:
    """rows (time) with slice: slices of so many days, where up to `jitter` days later decide by the key; a last slice has one row without anything but a time far behind all, which moves the watermark on."""
    late = F.pmod(F.xxhash64(key), F.lit(jitter * 86400))
    dealt = rows.withColumn("slice", F.floor((F.unix_seconds("time") + late) / (days * 86400)).cast("int"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "time"]
    beat = rows.agg((F.max("time") + F.expr("interval 4000 days")).alias("time")).select("time", *empty, F.lit(2**31 - 1).alias("slice"))
    return dealt.unionByName(beat)


def timed_log(spark: SparkSession, d: str) -> DataFrame:
    log = call_log(spark, d)
    return log.withColumns({"time": F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("bigint")), "call_id": F.concat_ws("/", F.col("caller_id").cast("string"), F.floor(F.col("ts") / 86400).cast("string"), F.col("request_count").cast("string"))})


STATES_SQL = """, last_ as (select t.instance_id, t.turn_id, s.field, arg_max(struct_pack(v := s.value), s.turn_id).v v from (select distinct instance_id, turn_id from shifts) t join given s on s.instance_id = t.instance_id and s.turn_id <= t.turn_id group by all),
 wishes as (select instance_id, turn_id, string_agg(field || '=' || coalesce(v, 'null'), ';' order by field) constraints from last_ group by all)
 select instance_id, cast(turn_id as bigint) turn_id, coalesce(constraints, '') constraints, op, array_to_string(old, ',') \"old\", array_to_string(new_, ',') \"new\" from fold left join wishes using (instance_id, turn_id) where turn_id >= 0"""


@query(PRIORITY_SQL + STATES_SQL)
def stream_intentions(spark: SparkSession, d: str) -> DataFrame:
    first, made = order_shifts(spark, d, timed=True)
    since = F.lit(made.agg(F.min("time")).first()[0])
    start = first.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("own"))
    start = start.select("instance_id", F.col("own.field").alias("fields"), F.col("own.value").alias("values"), F.array().cast("array<string>").alias("priority"), since.alias("since"))
    rows = made.select("instance_id", "turn_id", "time", "op", "field", "value", "priority_update")
    groups = streams.groups_for(table(spark, d, "orders").count())
    states = drained(spark, out_of_order(rows, 1200, 60, "turn_id"), lambda s: streams.stream_intentions(s, start, "61 days", 3650 * streams.DAY_MS, groups))
    held = F.array_sort(F.map_entries(F.from_json("constraints", "map<string,string>")))
    shown = F.transform(held, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return states.select("instance_id", "turn_id", F.array_join(shown, ";").alias("constraints"), "op", F.array_join("old", ",").alias("old"), F.array_join("new", ",").alias("new"))


@query(f"with {STEPS_SQL} select instance_id, turn_id, max(step_index) step_index, coalesce(max(stop_reason), 'step_budget') stop_reason from stopped group by all")
def stream_stop_monitor(spark: SparkSession, d: str) -> DataFrame:
    judged = judged_steps(spark, d).withColumn("signature", F.to_json(steps.action_signature()))
    rows = judged.select("instance_id", "turn_id", F.col("step_index").cast("long").alias("step_index"), "time", "action_type", "status", "env_done", "all_satisfied", "ready", "signature", F.col("made_progress").alias("progress"))
    groups = streams.groups_for(table(spark, d, "events").count())
    return drained(spark, out_of_order(rows, 15, 1, "step_index"), lambda s: streams.stream_stop_monitor(s, steps.MAX_STEPS, "2 days", groups=groups))


def _dealt_log(spark: SparkSession, d: str) -> DataFrame:
    return out_of_order(timed_log(spark, d), 15, 1, "event_id")


@query(f"with {LOG_SQL} select epoch_ms(cast(floor(ts / 60) * 60000 as bigint)) w, count(*) filter (event = 'request') requests, count(*) filter (event = 'fallback') fallbacks, cast(sum(tokens) as bigint) tokens from lg group by 1")
def stream_token_rate(spark: SparkSession, d: str) -> DataFrame:
    rates = drained(spark, _dealt_log(spark, d), lambda s: streams.stream_token_rate(s, late="2 days", ids=("event_id",)))
    return rates.select(F.col("start").cast("timestamp_ntz").alias("w"), "requests", "fallbacks", "tokens")


# The rows of the first days come a second time, after the watermark: they count as late and change no window.
@query(f"""with {LOG_SQL}, m as (select cast(floor(ts / 60) as bigint) n, count(*) filter (event = 'request') requests, count(*) filter (event = 'fallback') fallbacks, sum(tokens) tokens from lg group by 1),
 late as (select count(*) n from lg where ts < (select min(ts) from lg) + 5 * 86400),
 v as (select m.n + k n, requests, fallbacks, tokens from m, (select unnest(range(5)) k))
 select epoch_ms((v.n - 4) * 60000) w, cast(sum(requests) as bigint) requests, cast(sum(fallbacks) as bigint) fallbacks, cast(sum(tokens) as bigint) tokens, any_value(late.n) late_rows from v, late group by v.n""")
def stream_token_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows, late = _dealt_log(spark, d), []
    first = timed_log(spark, d)
    again = first.where(F.col("ts") < first.agg(F.min("ts")).first()[0] + 5 * 86400).withColumn("event_id", -F.col("event_id")).withColumn("slice", F.lit(2**31 - 2))
    rates = drained(spark, rows.unionByName(again), lambda s: streams.stream_token_rate(s, over="5 minutes", late="2 days", ids=("event_id",)), watch=lambda q: late.append(streams.late_rows(q)))
    return rates.select(F.col("start").cast("timestamp_ntz").alias("w"), "requests", "fallbacks", "tokens", F.lit(sum(late)).cast("bigint").alias("late_rows"))


@query(f"with {LOG_SQL}, g as (select caller_id, ts, case when ts - lag(ts) over (partition by caller_id order by ts, event_id) < 21600 then 0 else 1 end new_ from lg), s as (select *, sum(new_) over (partition by caller_id order by ts rows unbounded preceding) n from g) select caller_id, count(distinct n) sessions, count(*) calls from s group by 1")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    bursts = drained(spark, timed_log(spark, d), lambda s: streams.stream_sessions(s, gap="6 hours"), "complete")
    return bursts.groupBy("caller_id").agg(F.count("*").alias("sessions"), F.sum("calls").alias("calls"))


# Requests without an outcome come out once the watermark, ten minutes before the last request or outcome, has passed their bound.
LATENCY_SQL = f"""with {LOG_SQL}, timed as (select caller_id || '/' || cast(floor(ts / 86400) as bigint) || '/' || request_count call_id, make_timestamp(cast(round(ts * 1000000) as bigint)) at_, event from lg where request_count is not null),
 asked as (select call_id, at_ asked from timed where event = 'request'), done as (select call_id, at_ done, event outcome from timed where event in ('success', 'fallback')),
 passed as (select least((select max(asked) from asked), (select max(done) from done)) - interval 10 minutes w)"""


@query(LATENCY_SQL + " select a.call_id, asked, done, outcome from asked a left join done b on a.call_id = b.call_id and done >= asked and done <= asked + interval 12 hours, passed where done is not null or asked + interval 12 hours < w")
def stream_call_latency(spark: SparkSession, d: str) -> DataFrame:
    calls = drained(spark, timed_log(spark, d), lambda s: streams.stream_call_latency(s, within="12 hours"))
    return calls.select("call_id", F.col("asked").cast("timestamp_ntz").alias("asked"), F.col("done").cast("timestamp_ntz").alias("done"), "outcome")


@query(f"with {LOG_SQL} select distinct query, cast(k as bigint) k from lg where event = 'request'")
def stream_dedup_calls(spark: SparkSession, d: str) -> DataFrame:
    first = drained(spark, timed_log(spark, d).where("event = 'request'"), lambda s: streams.stream_dedup_calls(s, late="3650 days"))
    return first.select("query", F.col("k").cast("bigint").alias("k"))
