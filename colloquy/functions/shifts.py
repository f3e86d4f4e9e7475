"""Column expressions that turn raw change descriptions into valid shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, none_like, strip, truthy

# Fixed values of the domain.
OPS = ("none", "add", "relax", "override", "reprioritize", "scope_correction")
ASSIGNING = ("add", "relax", "override", "scope_correction")
CONDITIONS = ("none", "user_preference", "real_world_feasibility", "agent_misunderstanding")
STYLES = ("explicit", "partial", "elliptical")
DIRECTNESS = ("direct", "indirect")
CONDITION_ALIASES = {"preference": "user_preference", "preference_change": "user_preference", "userpreference": "user_preference", "feasibility": "real_world_feasibility", "real_world": "real_world_feasibility", "realworldfeasibility": "real_world_feasibility", "agent_error": "agent_misunderstanding", "misunderstanding": "agent_misunderstanding"}
CATEGORY_ALIASES = {"scope(entity)_correction": "scope_correction", "scope_entity_correction": "scope_correction"}
PREFERENCE_CUES = ("suddenly", "don't want", "do not want", "want something else", "rather", "instead", "bored", "tired of", "change my mind", "changed my mind", "don't like", "do not like")
FEASIBILITY_CUES = ("unavailable", "hard to satisfy", "not available")
MISUNDERSTANDING_CUES = ("misunder", "clarif", "too coarse")
SCOPE_CUES = ("refin", "clarif", "specific")


def has_any(c: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | c.contains(cue)
    return out


def _in_domain(c: Column, aliases: dict[str, str], domain: tuple[str, ...]) -> Column:
    name = F.replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    known = {d: d for d in domain} | aliases
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[name], F.lit("none"))


def alias_condition(c: Column) -> Column:
    return _in_domain(c, CONDITION_ALIASES, CONDITIONS)


def alias_category(c: Column) -> Column:
    return _in_domain(c, CATEGORY_ALIASES, OPS)


def field_name(c: Column) -> Column:
    """A field as written in a shift: lower case, spaces as underscores; blank is null."""
    return truthy(F.lower(F.replace(strip(c), F.lit(" "), F.lit("_"))))


def match_field(raw: Column, known: Column) -> Column:
    """The first known field that equals raw but for case and spaces."""
    return bound(field_name(raw), lambda name: F.get(F.filter(known, lambda k: F.lower(k) == name), F.lit(0)))


def infer_category(priority_update: Column, rationale: Column, field: Column, old_value: Column, value: Column) -> Column:
    old, new, why = none_like(old_value), none_like(value), F.lower(strip(rationale))
    return (
        F.when(F.size(F.coalesce(priority_update, F.array().cast("array<string>"))) > 0, "reprioritize")
        .when(bound(why, lambda w: has_any(w, SCOPE_CUES)), "scope_correction")
        .when(old.isNotNull() & new.isNotNull() & (old != new), "override")
        .when(old.isNotNull() & new.isNull(), "relax")
        .when(field.isNotNull() & old.isNull() & new.isNotNull(), "add")
        .otherwise("none")
    )


def infer_condition(op: Column, rationale: Column) -> Column:
    cued = lambda why: F.when(has_any(why, PREFERENCE_CUES), "user_preference").when(has_any(why, FEASIBILITY_CUES), "real_world_feasibility").when(has_any(why, MISUNDERSTANDING_CUES), "agent_misunderstanding").otherwise("user_preference")
    return F.when(op == "scope_correction", "agent_misunderstanding").otherwise(bound(F.lower(strip(rationale)), cued))


def number_of(c: Column) -> Column:
    return strip(c).try_cast("double")


def number_text(c: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def coerce_value(field: Column, value: Column, old_value: Column, kind: Column | None = None) -> Column:
    """The value as text in the form that the old value has: truth, number or plain text; a failed number stays text.

    kind, as variant_kind gives it, is the old value's type; without it the type is guessed from its text.
    """
    truth = lambda new: F.when(F.lower(new).isin("true", "yes", "1"), "true").when(F.lower(new).isin("false", "no", "0"), "false").otherwise("true")
    guessed = F.when(F.lower(old_value).isin("true", "false"), "boolean").when(number_of(old_value).isNotNull(), "float").otherwise("text")
    known = guessed if kind is None else F.coalesce(kind, guessed)

    def coerced(new: Column, known: Column) -> Column:
        numeric = known.isin("int", "float") | field.endswith("_max") | field.endswith("_min")
        number = bound(F.when(numeric, number_of(new)), lambda n: F.coalesce(number_text(n), strip(new)))
        return F.when(new.isNull(), F.lit(None)).when(known == "boolean", truth(new)).otherwise(number)

    return bound(none_like(value), lambda new: bound(known, lambda k: coerced(new, k)))


def relax_value(field: Column, old_value: Column) -> Column:
    """A bound loosened by a quarter or a fifth, to cents, half up; other fields give up their value."""
    old = number_of(old_value)
    return F.when(old.isNull(), F.lit(None)).when(field.endswith("_max"), number_text(F.round(old * 1.25, 2))).when(field.endswith("_min"), number_text(F.round(old * 0.8, 2)))


def is_relaxation(field: Column, old_value: Column, new_value: Column) -> Column:
    old, new = number_of(old_value), number_of(new_value)
    both = old.isNotNull() & new.isNotNull()
    return F.when(new_value.isNull(), old_value.isNotNull()).when(both & field.endswith("_min"), new <= old).when(both, new >= old).otherwise(~new_value.eqNullSafe(old_value))


def variant_kind(v: Column) -> Column:
    """boolean, int, float, text or other, by the type of a VARIANT; null is none. 30.0 is a float, "30.0" a text."""
    t = F.schema_of_variant(v)
    number = F.when(t == "BIGINT", "int").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float")
    return F.coalesce(F.when(t.isNull() | (t == "VOID"), "none").when(t == "BOOLEAN", "boolean").when(t == "STRING", "text"), number, F.lit("other"))


def coerce_variant(field: Column, value: Column, old_value: Column) -> Column:
    """A VARIANT value in the type of the old one: truth, whole number, number; where it can't be, or the old one is a text, as it is.

    Bounds (_max, _min) become numbers whatever the old value is. Blank texts, none and null are null; other texts lose
    white space at their ends where no type asks for more.
    """
    kind, old = variant_kind(value), variant_kind(old_value)
    said = F.lower(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double")
    nothing = (kind == "none") | ((kind == "text") & none_like(F.try_variant_get(value, "$", "string")).isNull())
    truth = F.when((kind == "text") & said.isin("true", "yes", "1"), True).when((kind == "text") & said.isin("false", "no", "0"), False).when(kind == "text", True).otherwise(F.coalesce(number != 0, F.lit(True)))
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("variant")).otherwise(number.cast("variant"))
    bound_ = (old == "float") | ((old != "int") & (field.endswith("_max") | field.endswith("_min")))
    plain = F.when(kind == "text", strip(F.try_variant_get(value, "$", "string")).cast("variant")).otherwise(value)
    return (
        F.when(nothing, F.lit(None).cast("variant"))
        .when(old == "boolean", truth.cast("variant"))
        .when((old == "int") & number.isNotNull(), whole)
        .when(bound_ & number.isNotNull(), number.cast("variant"))
        .when((old == "int") | bound_, value)
        .otherwise(plain)
    )


def relax_variant(field: Column, old_value: Column) -> Column:
    """A bound that is a number loosened by a quarter or a fifth, to cents, half up; a text is no number, and other wishes are given up."""
    number = F.when(variant_kind(old_value).isin("int", "float", "boolean"), F.try_variant_get(old_value, "$", "double"))
    loose = F.when(field.endswith("_max"), F.round(number * 1.25, 2)).when(field.endswith("_min"), F.round(number * 0.8, 2))
    return F.when(loose.isNotNull(), loose.cast("variant"))


def is_variant_relaxation(field: Column, old_value: Column, new_value: Column) -> Column:
    """Whether the new value asks for less: nothing, a looser bound, or, where one is no number, anything else."""
    old_kind, new_kind = variant_kind(old_value), variant_kind(new_value)
    numbers = old_kind.isin("int", "float", "boolean") & new_kind.isin("int", "float", "boolean")
    old, new = F.try_variant_get(old_value, "$", "double"), F.try_variant_get(new_value, "$", "double")
    other = ~((old_kind == new_kind) & F.to_json(new_value).eqNullSafe(F.to_json(old_value)))
    return F.when(new_kind == "none", old_kind != "none").when(numbers & field.endswith("_min"), new <= old).when(numbers, new >= old).otherwise(other)


def move_to_front(field: Column, priority: Column) -> Column:
    return F.concat(F.array(field), F.filter(priority, lambda p: p != field))


def priority_update(raw: Column, known: Column) -> Column:
    """Known fields named in raw, each once, then the rest of the known; null if raw is empty."""
    named = F.filter(F.transform(raw, lambda r: match_field(r, known)), lambda x: x.isNotNull())
    return F.when(F.size(F.coalesce(raw, F.array().cast("array<string>"))) > 0, F.array_distinct(F.concat(named, known)))


def utterance_plan(style: Column, directness: Column, mention_old: Column) -> Column:
    def one_of(c: Column, domain: tuple[str, ...], default: str) -> Column:
        low = F.lower(strip(c))
        return F.when(low.isin(*domain), low).otherwise(default)

    return F.struct(one_of(style, STYLES, "partial").alias("style"), one_of(directness, DIRECTNESS, "direct").alias("directness"), F.coalesce(mention_old, F.lit(False)).alias("mention_old_value"))


def format_value(c: Column) -> Column:
    """Text for a sentence: numbers to two places without trailing zeros; null is `no preference`."""
    number = number_of(c)
    cents = F.regexp_replace(F.regexp_replace(F.round(number, 2).cast("decimal(38,2)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), "no preference").when(number.isNotNull(), cents).otherwise(c)


def fallback_utterance(op: Column, field: Column, value: Column, old_value: Column, front: Column, style: Column, mention_old: Column) -> Column:
    """A sentence for a shift when no model wrote one."""
    style = F.when(style.isin(*STYLES), style).otherwise("explicit")
    name = F.coalesce(F.replace(truthy(field), F.lit("_"), F.lit(" ")), F.lit("that"))
    new, old = format_value(value), format_value(old_value)
    named_old = F.coalesce(mention_old, F.lit(False)) & old_value.isNotNull()
    target = F.coalesce(F.replace(F.coalesce(front, field), F.lit("_"), F.lit(" ")), F.lit("that"))
    capital = F.concat(F.upper(F.substring(target, 1, 1)), F.lower(F.substr(target, F.lit(2))))

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def by_style(explicit: Column, partial: Column, elliptical: Column) -> Column:
        return F.when(style == "explicit", explicit).when(style == "partial", partial).otherwise(elliptical)

    relax = by_style(F.when(named_old, say("It doesn't have to be exactly ", old, "; ", new, " is fine.")).otherwise(say("It doesn't have to be exactly ", name, ".")), say(name, " can be a bit flexible."), F.lit("Close is fine."))
    add = by_style(say("Also, I'd prefer ", name, " ", new, "."), say("Also, ", new, " would be nice."), say(new, " too."))
    override = by_style(F.when(named_old, say("Actually, change ", name, " from ", old, " to ", new, ".")).otherwise(say("Actually, make it ", new, " instead.")), say("Let's go with ", new, " instead."), say(new, " instead."))
    first = by_style(say(capital, " matters more now."), say("Focus more on ", target, "."), say(target, " first."))
    scope = by_style(F.when(named_old, say("I mean ", new, ", not just ", old, ".")).otherwise(say("I mean ", name, " ", new, ".")), say("More specifically, ", new, "."), say(name, " ", new, "."))
    return F.when(op == "none", "Let's keep looking.").when(op == "relax", relax).when(op == "add", add).when(op == "override", override).when(op == "reprioritize", first).when(op == "scope_correction", scope).otherwise("Please update that requirement.")


def shift_evidence(changed: Column, condition: Column, category: Column, op: Column, field: Column, old_value: Column, value: Column, update: Column, rationale: Column) -> Column:
    """The shift condition and the trigger evidence; without a change no condition and empty evidence."""
    details = F.struct(F.lit(True).alias("intention_changed"), condition.alias("condition"), category.alias("change_category"), op.alias("op"), field.alias("field"), old_value.alias("old_value"), value.alias("value"), update.alias("priority_update"))
    cause = F.struct(condition.alias("type"), rationale.alias("reason"), F.lit("simulator").alias("source"), details.alias("details"))
    trigger = F.struct(F.when(changed, condition).otherwise("none").alias("trigger_type"), F.lit("simulator").alias("source"), F.when(changed, F.struct(category.alias("change_category"), op.alias("op"), field.alias("field"), rationale.alias("rationale"))).alias("details"))
    return F.struct(F.when(changed, cause).alias("shift_condition"), trigger.alias("trigger_evidence"))
