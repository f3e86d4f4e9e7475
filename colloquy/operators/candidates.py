"""Candidate items: the compact form of products that searches return and models see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import asin_key, clip_text, infer_brand, infer_color, limit_array, parse_price, text_of, truthy

STRINGS = "array<string>"
OPTIONS = "map<string,array<string>>"
#: Keys of an item as kept in step histories.
RETURNED = ("rank", "asin", "title", "price", "category", "brand", "color")


def empty(kind: str) -> Column:
    return (F.create_map() if kind.startswith("map") else F.array()).cast(kind)


def candidate(product: dict[str, Column], rank: Column, price: Column | None = None) -> Column:
    """The 14 fields of a candidate from a product's columns; price overrides the product's own."""
    p = product
    pricing = F.coalesce(p["pricing"], F.array().cast("array<double>"))
    own = F.coalesce(F.get(pricing, F.lit(0)), parse_price(p["Price"]))
    title = F.coalesce(truthy(p["Title"]), p["name"])
    description = F.coalesce(truthy(p["Description"]), p["full_description"])
    bullets = F.coalesce(p["BulletPoints"], empty(STRINGS))
    return F.struct(
        p["asin"].alias("asin"),
        rank.cast("int").alias("rank"),
        title.alias("title"),
        (own if price is None else F.coalesce(price, own)).alias("price"),
        F.slice(pricing, 1, 2).alias("pricing"),
        p["query"].alias("query"),
        p["category"].alias("category"),
        p["product_category"].alias("product_category"),
        clip_text(description, 1000).alias("description"),
        F.transform(F.slice(bullets, 1, 5), lambda b: clip_text(b, 500)).alias("bullet_points"),
        limit_array(p["Attributes"], 12).alias("attributes"),
        F.coalesce(p["options"], empty(OPTIONS)).alias("options"),
        infer_brand(p["brand_name"], F.lit(None), p["Title"]).alias("brand"),
        infer_color(p["Title"], p["Description"], bullets).alias("color"),
    )


PRODUCT = ("asin", "Title", "name", "pricing", "Price", "BulletPoints", "Attributes", "options", "Description", "full_description", "category", "product_category", "query", "brand_name")


def of_product(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in PRODUCT}


def candidate_items(products: DataFrame, rank_col: str) -> DataFrame:
    """products with the column candidate."""
    return products.withColumn("candidate", candidate(of_product(), F.col(rank_col)))


def compact_candidate(c: Column, original_rank: Column, include_description: bool = False) -> Column:
    """What a reranking model sees of a candidate."""
    fields = [
        c["asin"].alias("asin"),
        original_rank.alias("original_rank"),
        c["title"].alias("title"),
        c["price"].alias("price"),
        F.coalesce(truthy(c["product_category"]), c["category"]).alias("product_category"),
        c["query"].alias("query"),
        limit_array(c["attributes"], 12).alias("attributes"),
        F.coalesce(c["options"], empty(OPTIONS)).alias("options"),
        c["brand"].alias("brand"),
        F.transform(F.slice(F.coalesce(c["bullet_points"], empty(STRINGS)), 1, 3), lambda b: clip_text(b, 240)).alias("bullet_points"),
    ]
    if include_description:
        fields.append(clip_text(c["description"], 300).alias("description"))
    return F.struct(*fields)


def compact_candidates(df: DataFrame, include_description: bool = False) -> DataFrame:
    """df (candidate and, if there is one, its own original_rank) with the column compact."""
    own = F.col("original_rank").try_cast("int") if "original_rank" in df.columns else F.lit(None).cast("int")
    rank = F.coalesce(F.nullif(own, F.lit(0)), F.col("candidate.rank"))
    return df.withColumn("compact", compact_candidate(F.col("candidate"), rank, include_description))


def item_context(products: DataFrame, selections: DataFrame) -> DataFrame:
    """The item-page view of each selection (selection_id, selected_asin, page_type, selected_options); null off item pages or for unknown ids."""
    p = of_product("p.")
    bullets = F.coalesce(p["BulletPoints"], empty(STRINGS))
    pricing = F.coalesce(p["pricing"], F.array().cast("array<double>"))
    reviews = F.transform(F.slice(F.coalesce(F.col("p.Reviews"), F.array().cast("array<struct<score:string,summary:string,body:string>>")), 1, 3), lambda r: F.struct(r["score"].alias("score"), r["summary"].alias("summary"), r["body"].alias("body")))
    context = F.struct(
        F.col("s.selected_asin").alias("asin"),
        F.coalesce(truthy(p["Title"]), p["name"]).alias("title"),
        F.coalesce(F.get(pricing, F.lit(0)), parse_price(p["Price"])).alias("price"),
        F.slice(pricing, 1, 2).alias("pricing"),
        p["category"].alias("category"),
        p["product_category"].alias("product_category"),
        p["query"].alias("query"),
        p["Description"].alias("description"),
        F.slice(bullets, 1, 8).alias("bullet_points"),
        F.col("p.Rating").alias("rating"),
        limit_array(p["Attributes"], 12).alias("attributes"),
        F.col("p.MainImage").alias("main_image"),
        F.coalesce(p["options"], empty(OPTIONS)).alias("options"),
        F.coalesce(F.col("s.selected_options"), empty("map<string,string>")).alias("selected_options"),
        F.coalesce(F.col("p.option_to_image"), empty("map<string,string>")).alias("option_to_image"),
        reviews.alias("reviews"),
        F.col("p.instruction_text").alias("instruction_text"),
        F.col("p.instruction_attributes").alias("instruction_attributes"),
        infer_brand(p["brand_name"], F.lit(None), p["Title"]).alias("brand"),
        infer_color(p["Title"], p["Description"], bullets).alias("color"),
    )
    joined = selections.alias("s").join(products.alias("p"), (F.col("s.selected_asin") == F.col("p.asin")) & (F.col("s.page_type") == "item"), "left")
    return joined.select("s.*", F.when(F.col("p.asin").isNotNull(), context).alias("item_context"))


def candidate_of_context(c: Column, rank: Column) -> Column:
    """A candidate from an item context; null without an id."""
    made = F.struct(
        c["asin"].alias("asin"),
        rank.cast("int").alias("rank"),
        c["title"].alias("title"),
        c["price"].alias("price"),
        F.slice(F.coalesce(c["pricing"], F.array().cast("array<double>")), 1, 2).alias("pricing"),
        c["query"].alias("query"),
        c["category"].alias("category"),
        c["product_category"].alias("product_category"),
        clip_text(c["description"], 1000).alias("description"),
        F.transform(F.slice(F.coalesce(c["bullet_points"], empty(STRINGS)), 1, 5), lambda b: clip_text(b, 500)).alias("bullet_points"),
        limit_array(c["attributes"], 12).alias("attributes"),
        F.coalesce(c["options"], empty(OPTIONS)).alias("options"),
        c["brand"].alias("brand"),
        c["color"].alias("color"),
    )
    return F.when(truthy(text_of(c["asin"])).isNotNull(), made)


def candidate_from_context(df: DataFrame) -> DataFrame:
    """df (item_context) with the column candidate, unranked."""
    return df.withColumn("candidate", candidate_of_context(F.col("item_context"), F.lit(None)))


def candidates_from_visible(visible: DataFrame, catalog: DataFrame) -> DataFrame:
    """Visible items (request_id, pos, asin, title, price) as candidates: the catalogue's fields with the visible price, bare where the id is unknown."""
    key = truthy(asin_key(F.col("v.asin")))
    joined = visible.alias("v").join(catalog.alias("p"), key == F.col("p.asin"), "left")
    known = candidate(of_product("p."), F.col("v.pos"), F.col("v.price"))
    bare = F.struct(key.alias("asin"), F.col("v.pos").cast("int").alias("rank"), F.col("v.title").alias("title"), F.col("v.price").alias("price"), F.array().cast("array<double>").alias("pricing"), *(F.lit(None).cast("string").alias(c) for c in ("query", "category", "product_category")), F.lit("").alias("description"), empty(STRINGS).alias("bullet_points"), empty(STRINGS).alias("attributes"), empty(OPTIONS).alias("options"), *(F.lit(None).cast("string").alias(c) for c in ("brand", "color")))
    return joined.select("v.request_id", "v.pos", F.when(F.col("p.asin").isNotNull(), known).otherwise(bare).alias("candidate"))


def returned_items(candidates: Column, limit: int = 10) -> Column:
    """The first items with the keys of RETURNED, those that are null left out, as JSON texts."""
    return F.transform(F.slice(F.coalesce(candidates, empty_candidates()), 1, limit), lambda c: F.to_json(F.struct(*[c[k].alias(k) for k in RETURNED])))


def empty_candidates() -> Column:
    return F.array().cast("array<struct<asin:string,rank:int,title:string,price:double,pricing:array<double>,query:string,category:string,product_category:string,description:string,bullet_points:array<string>,attributes:array<string>,options:map<string,array<string>>,brand:string,color:string>>")


def merge_candidates(primary: DataFrame, secondary: DataFrame, limit: int = 20) -> DataFrame:
    """Both lists (request_id, pos, candidate) one after the other: the first of each id, or title where the id is blank; rows with neither go; cut to limit."""
    both = primary.withColumn("side", F.lit(0)).unionByName(secondary.withColumn("side", F.lit(1)))
    key = F.coalesce(truthy(asin_key(F.col("candidate.asin"))), truthy(F.col("candidate.title")))
    order = [F.col("side"), F.col("pos")]
    first = both.withColumn("key", key).where("key is not null").withColumn("nth", F.row_number().over(W.partitionBy("request_id", "key").orderBy(*order))).where("nth = 1")
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy(*order))).where(F.col("place") <= limit)
    return placed.select("request_id", F.col("place").alias("pos"), "candidate")


def lookup_products(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """df (asin and, if in hand, candidate) with the column product: the candidate in hand, else the catalogue's; null for unknown ids."""
    key = asin_key(F.col("d.asin"))
    joined = df.alias("d").join(catalog.alias("p"), key == F.col("p.asin"), "left")
    found = F.when(F.col("p.asin").isNotNull(), candidate(of_product("p."), F.lit(None)))
    in_hand = [F.col("d.candidate")] if "candidate" in df.columns else []
    return joined.select("d.*", F.coalesce(*in_hand, found).alias("product"))


def browse(catalog: DataFrame, mode: str, arg: str = "", limit: int = 20, order: str = "row_id") -> DataFrame:
    """The first products in table order: all, of a category, or of a stored query."""
    rows = {"all": catalog, "category": catalog.where(F.col("category") == arg), "query": catalog.where(F.col("query") == arg)}[mode]
    return rows.orderBy(order).limit(limit)


#: Rows that a request of browse_requests may ask for.
MOST_BROWSED = 1000


def browse_requests(catalog: DataFrame, requests: DataFrame, order: str = "row_id") -> DataFrame:
    """requests (request_id, mode, arg, limit) with rank and the columns of catalog: each request's first products in table order.

    mode is all, category or query; other modes, and nulls for category or query, find nothing. Products are placed
    once for each mode and argument that is asked for, up to MOST_BROWSED; a greater limit is an error.
    """
    wanted = requests.withColumn("arg", F.when(F.col("mode") == "all", "").otherwise(F.col("arg")))
    asked = wanted.select("mode", "arg").distinct()
    entries = catalog.withColumn("entry", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), a.alias("arg")) for m, a in (("all", F.lit("")), ("category", F.col("category")), ("query", F.col("query")))))))
    entries = entries.withColumns({"mode": F.col("entry.mode"), "arg": F.col("entry.arg")}).drop("entry").join(asked, ["mode", "arg"], "left_semi")
    # Each task keeps no more rows of a mode and argument than can be asked for, before they meet.
    placed = entries.withColumn("rank", F.row_number().over(W.partitionBy("mode", "arg").orderBy(order))).where(F.col("rank") <= MOST_BROWSED)
    too_many = F.raise_error(F.format_string("a request asks for more than %d rows", F.lit(MOST_BROWSED))).cast("int")
    limit = F.when(F.col("limit") > MOST_BROWSED, too_many).otherwise(F.col("limit"))
    checked = wanted.withColumn("limit", limit)
    return checked.join(placed, ["mode", "arg"]).where(F.col("rank") <= F.col("limit")).select("request_id", "rank", *catalog.columns)
