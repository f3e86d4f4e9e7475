"""Raw pages of an episode as observations: page type, items, instruction, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, instruction_from_text, is_asin, parse_price, strip, text_of, truthy
from .candidates import candidate_of_context, empty_candidates
from .constraints import feedback_reason

STRINGS = "array<string>"
# Actions, and other names that models give them.
ACTIONS = ("search", "click", "buy", "back_to_search", "next_page", "prev_page", "refine")
ACTION_ALIASES = {"search_results": "search", "inspect": "click", "open": "click", "select": "click", "purchase": "buy", "back": "back_to_search", "previous_page": "prev_page"}


def page_type(text: Column, clickables: Column | None = None, done: Column | None = None) -> Column:
    """done, item, results, search or unknown, by the first rule that fits."""
    low = F.lower(text_of(text))
    out = F.when(low.contains("buy now") | low.contains("product details") | low.contains("item page"), "item").when(low.contains("results") | low.contains("page 1") | low.contains("back to search"), "results").when(low.contains("instruction:") & low.contains("search"), "search")
    if clickables is not None:
        out = out.when(F.array_contains(clickables, "search"), "search")
    out = out.otherwise("unknown")
    return out if done is None else F.when(F.coalesce(done, F.lit(False)), "done").otherwise(out)


def no_results(text: Column, visible: Column | None = None) -> Column:
    """Whether a page says that nothing was found; never if it shows items."""
    low = F.lower(text_of(text))
    total = truthy(F.regexp_extract(low, r"total results:\s*(\d+)", 1))
    said = F.when(total.isNotNull(), F.ltrim(total, F.lit("0")) == "").otherwise(low.contains("no results") | low.contains("did not match any products"))
    return said if visible is None else F.when(F.size(F.coalesce(visible, F.array().cast("array<struct<asin:string>>"))) > 0, False).otherwise(said)


ITEM = "struct<asin:string,title:string,price:double,click_target:string>"


def visible_items(text: Column, kind: Column, clickables: Column | None = None) -> Column:
    """(asin, title, price, click_target) of the triples between [SEP] marks of a results page: after a triple three parts on, else one.

    The click target is the asin as the page's clickables write it.
    """
    none = F.array().cast("array<int>")

    def apart(hits: Column) -> Column:
        """The hits without those less than three parts after one that counts."""
        near = F.exists(F.when(F.size(hits) > 1, F.sequence(F.lit(1), F.size(hits) - 1)).otherwise(none), lambda j: F.get(hits, j) - F.get(hits, j - 1) < 3)
        take = lambda found, i: F.when(i >= F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(-3)) + 3, F.concat(found, F.array(i))).otherwise(found)
        return F.when(near, F.aggregate(hits, none, take)).otherwise(hits)

    def items(parts: Column) -> Column:
        def made(i: Column) -> Column:
            asin = F.get(parts, i)
            target = asin if clickables is None else F.when(F.array_contains(clickables, F.lower(asin)), F.lower(asin)).otherwise(asin)
            return F.struct(asin.alias("asin"), F.get(parts, i + 1).alias("title"), parse_price(F.get(parts, i + 2)).alias("price"), target.alias("click_target")).cast(ITEM)

        places = F.when(F.size(parts) > 2, F.sequence(F.lit(0), F.size(parts) - 3)).otherwise(none)
        hits = F.filter(places, lambda i: is_asin(F.get(parts, i)) & F.get(parts, i + 2).contains("$"))
        return F.transform(bound(hits, apart), made)

    found = bound(F.transform(F.split(text_of(text), r"\[SEP\]"), strip), items)
    return F.when(kind == "results", found).otherwise(F.array().cast(f"array<{ITEM}>"))


def selected_item(text: Column, kind: Column, context: Column) -> Column:
    """Title and price of an item page: the part before the first that begins with price:, else a short line; else from the context."""
    parts = F.filter(F.transform(F.split(text_of(text), r"\[SEP\]"), strip), lambda p: p != "")
    at = F.array_position(F.transform(parts, lambda p: F.lower(p).startswith("price:")), True).cast("int")
    lines = F.slice(F.filter(F.transform(F.split(text_of(text), "\r\n|\r|\n"), strip), lambda x: x != ""), 1, 10)
    line = F.get(F.filter(lines, lambda x: ~F.lower(x).contains("instruction:") & (F.length(x) < 200)), F.lit(0))
    named = F.when(at > 1, F.get(parts, at - 2))
    title = F.coalesce(truthy(F.coalesce(named, line)), context["title"])
    price = F.coalesce(F.when(at > 0, parse_price(F.get(parts, at - 1))), F.get(context["pricing"], F.lit(0)), context["price"])
    made = F.struct(title.alias("title"), price.alias("price"), *(context[c].alias(c) for c in ("asin", "category", "product_category", "rating", "brand", "color")))
    return F.when((kind == "item") & (title.isNotNull() | price.isNotNull()), made)


def classify_pages(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumns({"page_type": page_type(F.col(text)), "no_results": no_results(F.col(text)), "instruction": instruction_from_text(F.col(text)), "shown_price": parse_price(F.col(text))})


def normalize_pages(raw: DataFrame) -> DataFrame:
    """Raw pages (raw_text, clickables, done, item_context) as observations: type, instruction, visible items, the item's candidate, the selected item."""
    out = raw.withColumn("page_type", page_type(F.col("raw_text"), F.col("clickables"), F.col("done")))
    context = F.when(F.col("page_type") == "item", F.col("item_context"))
    return out.withColumns(
        {
            "instruction": instruction_from_text(F.col("raw_text")),
            "visible_items": visible_items(F.col("raw_text"), F.col("page_type"), F.col("clickables")),
            "item_candidate": candidate_of_context(context, F.lit(None)),
            "selected_item": selected_item(F.col("raw_text"), F.col("page_type"), context),
        }
    )


def carry_candidates(observations: DataFrame, limit: int = 20) -> DataFrame:
    """observations (session_id, step, page_type, candidates, item_candidate) with shown: a results page's own list, the last list on other pages, the item first on item pages."""
    own = F.when((F.col("page_type") == "results") & (F.size(F.coalesce("candidates", empty_candidates())) > 0), F.col("candidates"))
    w = W.partitionBy("session_id").orderBy("step")
    last = F.coalesce(F.last(own, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), empty_candidates())
    out = observations.withColumn("last", last)
    item = F.col("item_candidate")
    others = F.filter("last", lambda c: F.upper(c["asin"]) != F.upper(item["asin"]))
    on_item = F.when(item.isNotNull(), F.slice(F.concat(F.array(item), others), 1, limit)).otherwise(F.col("last"))
    return out.withColumn("shown", F.when(F.col("page_type") == "results", F.coalesce(own, empty_candidates())).when(F.col("page_type") == "item", on_item).otherwise(F.col("last"))).drop("last")


def action_type(c: Column) -> Column:
    name = F.lower(strip(c))
    out = name
    for alias, value in ACTION_ALIASES.items():
        out = F.when(name == alias, value).otherwise(out)
    return F.when(out.isin(*ACTIONS), out)


def validate_actions(outputs: DataFrame) -> DataFrame:
    """outputs (action_type, payload map, clickables, page_type) with action: type and payload if the page allows it, else null."""
    kind = action_type(F.col("action_type"))
    query, target = truthy(strip(F.col("payload")["query"])), truthy(strip(F.col("payload")["target"]))
    clicked = F.get(F.reverse(F.filter("clickables", lambda c: F.lower(c) == F.lower(target))), F.lit(0))
    may_click = F.when(~F.lower(clicked).isin("buy now", "buy"), clicked)
    none = F.create_map().cast("map<string,string>")
    pair = lambda key, value: F.struct(kind.alias("action_type"), F.create_map(F.lit(key), value).alias("payload"))
    plain = F.struct(kind.alias("action_type"), none.alias("payload"))
    action = F.when(kind.isin("search", "refine") & query.isNotNull(), pair("query", query)).when((kind == "click") & may_click.isNotNull(), pair("target", may_click)).when((kind == "buy") & (F.lower(F.col("page_type")) == "item"), plain).when(kind.isin("back_to_search", "next_page", "prev_page"), plain)
    return outputs.withColumn("action", action)


def option_target(request: Column, options: Column, selected: Column, clickables: Column) -> Column:
    """The first option whose value stands in the request, can be clicked and isn't selected yet."""
    low = F.lower(strip(request))

    def fitting(e: Column) -> Column:
        values = F.filter(F.transform(e["value"], lambda v: F.lower(strip(v))), lambda v: v != "")
        return F.get(F.filter(values, lambda v: F.contains(low, v)), F.lit(0))

    def target(e: Column) -> Column:
        value = fitting(e)
        chosen = F.lower(F.coalesce(selected[e["key"]], F.lit("")))
        return F.when(chosen != value, F.get(F.filter(clickables, lambda c: F.lower(c) == value), F.lit(0)))

    return F.get(F.filter(F.transform(F.map_entries(options), target), lambda t: t.isNotNull()), F.lit(0))


def fallback_actions(df: DataFrame) -> DataFrame:
    """df (action, utterance, page_type, visible_items, options, selected_options, clickables) with a rule's action where there is none."""
    request = strip(F.col("utterance"))
    page = F.lower(F.coalesce(truthy(F.col("page_type")), F.lit("search")))
    first = F.get(F.col("visible_items"), F.lit(0))
    shown = truthy(strip(F.coalesce(truthy(first["click_target"]), truthy(first["asin"]), first["title"])))
    option = option_target(F.col("utterance"), F.col("options"), F.coalesce("selected_options", F.create_map().cast("map<string,string>")), F.col("clickables"))
    act = lambda kind, key=None, value=None: F.struct(F.lit(kind).alias("action_type"), (F.create_map(F.lit(key), value) if key else F.create_map().cast("map<string,string>")).alias("payload"))
    rule = F.when((page == "results") & shown.isNotNull(), act("click", "target", shown)).when(page == "results", act("refine", "query", request)).when((page == "item") & option.isNotNull(), act("click", "target", option)).when(page == "item", act("buy")).otherwise(act("search", "query", request))
    return df.withColumn("next_action", F.coalesce("action", rule))


def page_view(df: DataFrame) -> DataFrame:
    """Observations cut for prompts: clickables, items, description and raw text at their limits."""
    return df.withColumns({"clickables": F.slice("clickables", 1, 40), "visible_items": F.slice("visible_items", 1, 10), "description": F.substring(text_of(F.col("description")), 1, 3000), "raw_text": F.substring(text_of(F.col("raw_text")), 1, 4000)})


def reasons(df: DataFrame) -> DataFrame:
    """df (raw_text, visible_items, satisfied, violated) with reason."""
    return df.withColumn("reason", feedback_reason(no_results(F.col("raw_text"), F.col("visible_items")), F.col("satisfied"), F.col("violated")))
