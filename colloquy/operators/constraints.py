"""Structured wishes of an intention, checked against candidates for whole tables of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attrs_from_text, bound, norm_text, normalize_category, selected_option, text_of, truthy

# Fields in the order in which they are asked for.
ROLLOUT = ("category", "color", "size", "brand")
SELECTABLE = ("color", "size", "brand")
CHECKED = ("budget_max", "color", "size", "brand", "category")


def active_constraints(constraints: Column) -> Column:
    """Fields whose value isn't null, from an array of (field, value)."""
    return F.transform(F.filter(constraints, lambda c: c["value"].isNotNull()), lambda c: c["field"])


def requested_constraints(constraints: Column, fields: tuple[str, ...] = ROLLOUT) -> Column:
    """Entries with a value among the fields, in the order of the fields."""

    def of(field: str) -> Column:
        return F.filter(constraints, lambda c: (c["field"] == field) & c["value"].isNotNull())

    return F.concat(*map(of, fields))


def sources(result: dict[str, Column], field: str) -> list[tuple[Column, str]]:
    """Where a field's actual value may stand, best first."""
    absent = F.lit(None).cast("string")
    of = lambda name: result.get(name, absent)
    if field in SELECTABLE:
        options = result.get("selected_options")
        found = [(absent if options is None else selected_option(options, field), f"selected_options.{field}"), (of(f"selected_{field}"), f"selected_{field}"), (of(field), field)]
        return found + [(of(f"base_{field}"), f"base_{field}")] * (field != "size")
    if field == "category":
        return [(of(c), c) for c in ("product_category", "base_category", "category")]
    return [(of(field), field)]


def resolve_actual(result: dict[str, Column], field: str) -> tuple[Column, Column]:
    """The first value that isn't null, and the name of its place."""
    found = sources(result, field)
    source = F.lit(None).cast("string")
    for value, name in reversed(found):
        source = F.when(value.isNotNull(), name).otherwise(source)
    return F.coalesce(*[v for v, _ in found]), source


#: Fields of a result whose texts a category wish is looked for in.
CATEGORY_TEXTS = ("product_category", "base_category", "category", "title", "query")


def category_texts(result: dict[str, Column]) -> Column:
    """The normal texts of a result that a category wish may fit, each once; a table of results can hold them ready as `texts`."""
    return F.array_distinct(F.filter(F.array(*[normalize_category(result[c]) for c in CATEGORY_TEXTS if c in result]), lambda t: t != ""))


def plain_values(result: dict[str, Column]) -> Column:
    """The actual colour, size and brand of a result as they are compared; a table of results can hold them ready as `plain`."""
    return F.struct(*(norm_text(resolve_actual(result, f)[0]).alias(f) for f in SELECTABLE))


def plain_wishes(constraints: Column) -> Column:
    """Constraints (field, value) with plain, the value as it is compared: as a category, or as text. evaluate takes both forms."""
    plain = lambda c: F.when(c["field"] == "category", normalize_category(c["value"])).otherwise(norm_text(c["value"]))
    return F.transform(constraints, lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"), plain(c).alias("plain")))


def category_matches(want: Column, texts: Column) -> Column:
    """Whether a text equals the wish, holds it, is held by it, or has all its tokens, both in normal form; null for an empty wish."""

    def matches(want: Column) -> Column:
        def fits(text: Column) -> Column:
            return F.contains(text, want) | F.contains(want, text) | (F.size(F.array_except(F.split(want, " "), F.split(text, " "))) == 0)

        return F.when(want != "", F.exists(texts, fits))

    return bound(want, matches)


def match(result: dict[str, Column], field: str, desired: Column, plain: Column | None = None) -> tuple[Column, Column, Column]:
    """(matched, actual, source): matched is null where the actual value isn't known. plain is the wish as plain_wishes gives it."""
    if field == "budget_max":
        price = result["price"]
        return price <= desired.try_cast("double"), price.cast("string"), F.lit("price")
    actual, source = resolve_actual(result, field)
    if field == "category":
        return F.when(actual.isNotNull(), category_matches(normalize_category(desired) if plain is None else plain, result["texts"] if "texts" in result else category_texts(result))), actual, source
    own = result["plain"][field] if "plain" in result else norm_text(actual)
    return F.when(actual.isNotNull(), own == (norm_text(desired) if plain is None else plain)), actual, source


def evaluate(result: dict[str, Column], constraints: Column, known: Column | None = None, plain: bool = False) -> Column:
    """One (field, desired, actual, source, matched, violated) for each checked field with a wish, in the order of the wishes.

    A category wish that says nothing is violated though its match is unknown. known says
    whether there is a result at all; without one nothing is checked. Texts of a result are made normal once for
    all its wishes, or come with it as `texts`; plain says whether constraints are those of plain_wishes.
    """

    def check(c: Column, matched: Column, actual: Column, source: Column) -> Column:
        def made(m: Column) -> Column:
            violated = F.when(actual.isNotNull(), ~F.coalesce(m, F.lit(False))).otherwise(False)
            return F.struct(c["field"].alias("field"), c["value"].alias("desired"), actual.alias("actual"), source.alias("source"), m.alias("matched"), violated.alias("violated"))

        return bound(matched, made)

    def checked(texts: Column) -> Column:
        def entry(c: Column) -> Column:
            out = F.lit(None)
            for field in reversed(CHECKED):
                out = F.when(c["field"] == field, check(c, *match(result | {"texts": texts}, field, c["value"], c["plain"] if plain else None))).otherwise(out)
            return out

        wishes = F.filter(constraints, lambda c: c["value"].isNotNull() & c["field"].isin(*CHECKED))
        if known is not None:
            wishes = F.when(known, wishes).otherwise(F.slice(constraints, 1, 0))
        return F.transform(wishes, entry)

    return checked(result["texts"]) if "texts" in result else bound(category_texts(result), checked)


def evaluate_constraints(pairs: DataFrame, result: dict[str, Column], known: Column | None = None) -> DataFrame:
    """pairs (constraints and the columns of result) with checks, satisfied and violated."""
    plain = "plain" in pairs.schema["constraints"].dataType.elementType.fieldNames()
    checked = pairs.withColumn("checks", evaluate(result, F.col("constraints"), known, plain))
    return checked.withColumns({"satisfied": F.transform(F.filter("checks", lambda c: F.coalesce(c["matched"], F.lit(False))), lambda c: c["field"]), "violated": F.transform(F.filter("checks", lambda c: c["violated"]), lambda c: c["field"])})


def extract_result(df: DataFrame) -> DataFrame:
    """df (selected_item, item_context, selected_options, raw_text) with the column result: selected options beat the context, it beats the text."""
    item, context = F.col("selected_item"), F.col("item_context")
    own_price = item["price"]
    text = F.when(item.isNotNull(), text_of(item["title"])).otherwise(text_of(F.col("raw_text")))
    text = F.when(own_price.isNotNull(), F.concat(text, F.lit(" $"), own_price.cast("string"))).otherwise(text)
    parsed = attrs_from_text(text)
    df = df.withColumn("parsed", parsed)
    p, options = F.col("parsed"), F.coalesce(F.col("selected_options"), context["selected_options"])
    color = F.coalesce(context["color"], p["color"])
    brand = context["brand"]
    category = F.coalesce(truthy(context["product_category"]), context["category"], p["category"])
    chosen = {f: selected_option(options, f) for f in SELECTABLE}
    result = F.struct(
        context["asin"].alias("asin"),
        F.coalesce(context["title"], item["title"]).alias("title"),
        F.coalesce(context["price"], p["price"], own_price).alias("price"),
        F.coalesce(context["category"], p["category"]).alias("category"),
        context["product_category"].alias("product_category"),
        context["query"].alias("query"),
        options.alias("selected_options"),
        color.alias("base_color"),
        brand.alias("base_brand"),
        category.alias("base_category"),
        *(chosen[f].alias(f"selected_{f}") for f in SELECTABLE),
        F.coalesce(chosen["color"], color).alias("color"),
        chosen["size"].alias("size"),
        F.coalesce(chosen["brand"], brand).alias("brand"),
    )
    return df.withColumn("result", result).drop("parsed")


def match_status(checks: Column, satisfied: Column, violated: Column, field: Column) -> Column:
    """True, false or unknown: from the checks, else from the two lists."""
    found = F.get(F.filter(checks, lambda c: (c["field"] == field) & c["matched"].isNotNull()), F.lit(0))["matched"]
    return F.coalesce(found, F.when(F.array_contains(satisfied, field), True).when(F.array_contains(violated, field), False))


def _status(c: Column) -> Column:
    return match_status(F.col("checks"), F.col("satisfied"), F.col("violated"), c)


def on_item_page() -> Column:
    return (F.col("page_type") == "item") & truthy(F.coalesce(truthy(F.col("selected_asin")), F.col("result_asin"))).isNotNull()


def all_requested_satisfied() -> Column:
    """On an item page with an id, something asked for and all of it matched."""
    met = lambda asked: (F.size(asked) > 0) & F.forall(asked, lambda c: F.coalesce(_status(c["field"]), F.lit(False)))
    return F.coalesce(on_item_page() & bound(requested_constraints(F.col("constraints")), met), F.lit(False))


def selectable_resolved() -> Column:
    """Every colour, size or brand asked for that the item offers as an option is matched."""
    offered = F.transform(F.map_keys(F.coalesce(F.col("options"), F.create_map().cast("map<string,array<string>>"))), norm_text)
    asked = requested_constraints(F.col("constraints"), SELECTABLE)
    return bound(offered, lambda o: F.forall(asked, lambda c: ~F.array_contains(o, c["field"]) | F.coalesce(_status(c["field"]), F.lit(False))))


def has_evidence() -> Column:
    """Any title, price, category or brand that isn't empty."""
    parts = [truthy(F.col(c)) for c in ("title", "category", "brand", "item_title")] + [F.col("price"), F.col("item_price")]
    out = F.lit(False)
    for part in parts:
        out = out | part.isNotNull()
    return out


def candidate_ready(resolved: Column | None = None) -> Column:
    asked = requested_constraints(F.col("constraints"), ("category",))
    return F.coalesce(on_item_page() & has_evidence() & F.forall(asked, lambda c: F.coalesce(_status(c["field"]), F.lit(False))) & (selectable_resolved() if resolved is None else resolved), F.lit(False))


def readiness(pages: DataFrame) -> DataFrame:
    """Evaluated item pages with all_satisfied, resolved, evidence and ready."""
    judged = pages.withColumns({"all_satisfied": all_requested_satisfied(), "resolved": selectable_resolved(), "evidence": has_evidence()})
    return judged.withColumn("ready", candidate_ready(F.col("resolved")))


def feedback_reason(no_results: Column, satisfied: Column, violated: Column) -> Column:
    return F.when(no_results, "no_matching_results").when((F.size(violated) > 0) & (F.size(satisfied) > 0), "partial_constraint_failure").when(F.size(violated) > 0, "constraint_mismatch")


def refresh_constraints(reranked: DataFrame, intents: DataFrame) -> DataFrame:
    """Constraints of each request (request_id, constraints) checked again for the candidate at rank 1."""
    top = reranked.where("rerank_rank = 1").select("request_id", "candidate")
    c = F.col("candidate")
    result = {f: c[f] for f in ("price", "color", "brand", "category", "product_category", "title", "query")}
    return evaluate_constraints(top.join(intents, "request_id"), result).select("request_id", c["asin"].alias("asin"), "satisfied", "violated")


def constraint_rates(evaluated: DataFrame) -> DataFrame:
    """Per field: how often its check was satisfied, violated or unknown, and the shares."""
    rows = evaluated.select(F.explode("checks").alias("c")).select("c.*")
    counted = rows.groupBy("field").agg(F.count("*").alias("checks"), F.count_if(F.col("matched")).alias("satisfied"), F.count_if(F.col("violated")).alias("violated"))
    unknown = F.col("checks") - F.col("satisfied") - F.col("violated")
    return counted.withColumns({"unknown": unknown, "satisfied_rate": F.round(F.col("satisfied") / F.col("checks"), 6), "violated_rate": F.round(F.col("violated") / F.col("checks"), 6)})
