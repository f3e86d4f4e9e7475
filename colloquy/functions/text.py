"""Column expressions for text, prices, options and catalogue fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all of Unicode, with the information separators.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Colours in the order in which they are looked for.
COLORS = ("black", "white", "gray", "grey", "blue", "red", "green", "teal", "pink", "brown")
# Words that a category name does without.
CATEGORY_STOPS = ("s", "and", "a", "an", "the", "for", "with")
# Other names of constraint fields.
FIELD_ALIASES = {"max_price": "budget_max", "maximum_price": "budget_max", "price_max": "budget_max", "budget": "budget_max", "budget_limit": "budget_max", "product_type": "category", "item_type": "category"}
PRICE = r"\$([0-9]+(?:\.[0-9]+)?)"


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column) -> Column:
    """The value as text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def truthy(c: Column) -> Column:
    """Text that is neither null nor empty; else null."""
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(text_of(c), SPACE, " "))


def norm_text(c: Column) -> Column:
    return F.lower(collapse(c))


def clip_text(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


def strip(c: Column) -> Column:
    """Text without white space at the ends; null is empty."""
    return F.btrim(text_of(c), F.lit(SPACES))


def clean_query(c: Column) -> Column:
    """Collapsed text; null where it is blank, none or null."""
    q = collapse(c)
    return F.when(~F.lower(q).isin("", "none", "null"), q)


def resolve_query(gold: Column, search: Column, request: Column, utterance: Column) -> Column:
    """The first usable query of an intention, else the utterance; empty if there is none."""
    return F.coalesce(clean_query(gold), clean_query(search), clean_query(request), clean_query(utterance), F.lit(""))


def query_from_intention(stored: Column, category: Column, color: Column, brand: Column, size: Column, request: Column) -> Column:
    """The stored query; else category, colour, brand and size; else the request."""
    composed = collapse(F.concat_ws(" ", truthy(category), color, brand, size))
    any_part = truthy(category).isNotNull() | color.isNotNull() | brand.isNotNull() | size.isNotNull()
    return F.coalesce(clean_query(stored), F.when(any_part, composed), clean_query(request))


def parse_price(c: Column) -> Column:
    """The number after the first dollar sign that has one: $1,299.00 gives 1.0."""
    return truthy(F.regexp_extract(text_of(c), PRICE, 1)).try_cast("double")


def is_asin(c: Column) -> Column:
    return strip(c).rlike("^[A-Z0-9]{10}$")


def asin_key(c: Column) -> Column:
    return F.upper(strip(c))


def infer_brand(brand: Column, other_brand: Column, title: Column) -> Column:
    """A named brand; else the first three words of the title before a dash, colon, bar or comma."""
    words = F.split(collapse(F.split(strip(title), "[-:|,]", 2)[0]), " ")
    guess = truthy(F.array_join(F.slice(words, 1, 3), " "))
    return F.coalesce(truthy(strip(brand)), truthy(strip(other_brand)), guess)


def first_word_in(c: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that is a substring of c."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), w) for w in words])


def infer_color(title: Column, description: Column, bullets: Column) -> Column:
    return first_word_in(F.lower(F.concat_ws(" ", text_of(title), text_of(description), F.array_join(F.coalesce(bullets, F.array().cast("array<string>")), " "))), COLORS)


def attrs_from_text(c: Column) -> Column:
    """Price, and hints of category and colour, from free text."""
    low = F.lower(text_of(c))
    category = F.when(low.contains("chair"), "office chair").when(low.contains("jumpsuit") | low.contains("rompers") | low.contains("overalls"), "jumpsuit").when(low.contains("shirt"), "shirt").when(low.contains("shoe"), "shoes")
    return F.struct(parse_price(c).alias("price"), category.alias("category"), first_word_in(low, COLORS).alias("color"))


def normalize_category(c: Column) -> Column:
    """Lower-case tokens without stop words and plural endings, joined by spaces."""
    plain = F.replace(F.replace(F.replace(norm_text(c), F.lit("â€º"), F.lit(" ")), F.lit("›"), F.lit(" ")), F.lit("&"), F.lit(" and "))
    tokens = F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), 0), lambda t: ~t.isin(*CATEGORY_STOPS))

    def singular(t: Column) -> Column:
        n = F.length(t)
        return F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when(t.endswith("s") & (n > 3), F.substring(t, F.lit(1), n - 1)).otherwise(t)

    return F.array_join(F.transform(tokens, singular), " ")


def selected_option(options: Column, name: str) -> Column:
    """Value of the first option of that name, whatever its case and spacing; blank is null."""
    found = F.filter(F.map_entries(options), lambda e: norm_text(e["key"]) == name)
    return truthy(collapse(F.get(found, F.lit(0))["value"]))


def clean_request(c: Column) -> Column:
    return strip(F.regexp_replace(text_of(c), rf"(?i)^({SPACE})?instruction:", ""))


def instruction_from_text(c: Column) -> Column:
    """Text after Instruction: up to the first of the markers that come after its first character."""
    out = F.when(c.contains("Instruction:"), strip(F.substr(c, F.instr(c, "Instruction:") + F.lit(len("Instruction:"))))).otherwise("")
    for stop in ("[SEP]", "Available actions:", "Search", "Results"):
        at = F.instr(out, stop)
        out = F.when(at > 1, strip(F.substring(out, F.lit(1), at - F.lit(1)))).otherwise(out)
    return out


def coerce_int(c: Column, default: Column | None = None) -> Column:
    got = truthy(strip(c)).try_cast("int")
    return got if default is None else F.coalesce(got, default)


def string_list(c: Column, n: int = 180) -> Column:
    """Items that aren't blank, clipped; a null list is empty."""
    kept = F.filter(c, lambda x: F.coalesce(strip(x), F.lit("")) != "")
    return F.coalesce(F.transform(kept, lambda x: clip_text(x, n)), F.array().cast("array<string>"))


def limit_array(c: Column, n: int) -> Column:
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)


def limit_map(c: Column, n: int) -> Column:
    return F.map_from_entries(F.slice(F.map_entries(c), 1, n))


def constraint_key(c: Column) -> Column:
    """A field's plain name: lower case, other characters as single underscores, aliases resolved."""
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9_]+", "_"), "_+", "_"), "^_|_$", "")
    out = key
    for alias, field in FIELD_ALIASES.items():
        out = F.when(key == alias, field).otherwise(out)
    return out


def constraint_value(field: Column, c: Column) -> Column:
    """A constraint's value as text; blank and none-like are null; a budget is its first number."""
    value = collapse(c)
    value = F.when(~F.lower(value).isin("", "none", "null", "unknown", "not specified"), value)
    number = truthy(F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0)).try_cast("double")
    return F.when(field == "budget_max", number.cast("string")).otherwise(value)


def none_like(c: Column) -> Column:
    return F.when(~F.lower(strip(c)).isin("", "none", "null"), c)


def extract_json(c: Column) -> Column:
    """The JSON object in model output, as text: without a code fence, else from the first { to the last }; else null."""

    def unfenced(t: Column) -> Column:
        return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, rf"^```(?:json)?({SPACE})?", ""), rf"({SPACE})?```$", "")).otherwise(t)

    # Spark's parser stops after one value; inside brackets of two kinds nothing may follow it. Prose, which no value
    # begins like, isn't parsed: a failed parse costs far more than a good one.
    def is_json(t: Column) -> Column:
        listed, named = F.concat(F.lit("["), t, F.lit("]")), F.concat(F.lit('{"x":'), t, F.lit("}"))
        return t.rlike(r'^[\[{"\-0-9tfn]') & F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull() & (F.json_array_length(listed) == 1)

    def is_object(t: Column) -> Column:
        return is_json(t) & strip(t).startswith("{")

    def inner_of(t: Column) -> Column:
        return bound(truthy(F.regexp_extract(t, r"(?s)\{.*\}", 0)), lambda i: F.when(is_object(i), i))

    # Each text is made once, and parsed as a whole once: what is JSON but no object has no inner one.
    def object_of(t: Column) -> Column:
        return F.when(F.coalesce(is_json(t), F.lit(False)), F.when(strip(t).startswith("{"), t)).otherwise(inner_of(t))

    return bound(bound(strip(c), unfenced), object_of)
