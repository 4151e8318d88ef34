"""Reading schema.org values whose members may be text, numbers, objects or lists.

Values are VARIANT columns, so a text that happens to start with a bracket is never mistaken for a list.  Nested lists and
objects are opened level by level inside the row, in a fold that goes on until nothing is left to open: a value costs as
many levels as it has, and there is no deepest one.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from .. import rules
from .core import WS, apply_sql, let, sql_text
from .salary import salary_text


def kind(value: Column) -> Column:
    """``STRING``, ``ARRAY``, ``OBJECT``, ``BOOLEAN``, ``VOID`` or a numeric type; NULL for a missing member."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def elements(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def filled(value: Column) -> Column:
    """The value unless it is missing, empty, zero or false; a text is empty only if it has no characters."""
    return F.when(apply_sql(value, f"f -> {_filled_sql('f')}"), value)


def _kind_sql(v: str) -> str:
    return f"regexp_extract(schema_of_variant({v}), '^([A-Z]+)', 1)"


def _filled_sql(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL THEN false ELSE CASE {_kind_sql(v)} WHEN 'STRING' THEN cast({v} AS string) <> ''
        WHEN 'VOID' THEN false WHEN 'BOOLEAN' THEN cast({v} AS boolean) WHEN 'OBJECT' THEN schema_of_variant({v}) <> 'OBJECT<>'
        WHEN 'ARRAY' THEN size(try_variant_get({v}, '$', 'array<variant>')) > 0
        ELSE coalesce(try_cast({v} AS double) <> 0, true) END END"""


def _until_closed(first: str, levels: str, step: str, is_open: str) -> str:
    """SQL of a fold that rewrites the items ``first`` by ``step`` (of ``x``) as long as one of them ``is_open`` (of ``x``).

    ``levels`` is any number at least as large as the levels there are; rounds after the last one change nothing.
    """
    opened = f"flatten(transform(acc.items, x -> {step}))"
    return f"""aggregate(sequence(1, {levels}), named_struct('items', {first}, 'open', exists({first}, x -> {is_open})),
        (acc, i) -> CASE WHEN acc.open THEN transform(array({opened}), o -> named_struct('items', o, 'open', exists(o, x -> {is_open})))[0]
          ELSE acc END, acc -> acc.items)"""


def _levels_sql(text: str) -> str:
    """Brackets in a JSON text: at least as many as its deepest nesting."""
    return f"(1 + length({text}) - length(translate({text}, '[{{', '')))"


@lru_cache(maxsize=1)
def _as_text_lambda() -> str:
    """Open lists and objects until none is left, then join the scalars.

    A list opens into its items, an object into the first filled one of its naming members.
    """
    members = [f"try_variant_get(x, '$[\"{k}\"]', 'variant')" for k in rules.TEXT_KEYS]
    first = ", ".join(f"transform(array({m}), f -> CASE WHEN {_filled_sql('f')} THEN f END)[0]" for m in members)
    step = f"""CASE {_kind_sql("x")} WHEN 'ARRAY' THEN try_variant_get(x, '$', 'array<variant>')
        WHEN 'OBJECT' THEN array_compact(array(coalesce({first}))) ELSE array(x) END"""
    is_open = f"coalesce({_kind_sql('x')} IN ('ARRAY', 'OBJECT'), false)"
    # A long text is read for its ends only if there is something to strip.
    space = sql_text(f"(?U)[{WS}]")
    trimmed = f"""CASE WHEN substr(t, 1, 1) rlike {space} OR substr(t, -1, 1) rlike {space}
        THEN regexp_replace(t, {sql_text(rf"(?U)^[{WS}]+|[{WS}]+" + chr(92) + "z")}, '') ELSE t END"""
    scalar = f"""CASE WHEN y IS NULL OR {_kind_sql("y")} = 'VOID' THEN ''
        WHEN {_kind_sql("y")} = 'BOOLEAN' THEN initcap(cast(y AS string))
        ELSE transform(array(coalesce(try_cast(y AS string), '')), t -> {trimmed})[0] END"""
    levels = f"CASE WHEN coalesce({_kind_sql('v')} IN ('ARRAY', 'OBJECT'), false) THEN {_levels_sql('cast(v AS string)')} ELSE 1 END"
    return f"v -> array_join(filter(transform({_until_closed('array(v)', levels, step, is_open)}, y -> {scalar}), t -> t <> ''), '; ')"


def as_text(value: Column) -> Column:
    """Flatten a value to text; list items are joined by ``; ``."""
    return apply_sql(value, _as_text_lambda())


def location_text(value: Column) -> Column:
    """``locality, region, country`` of each place, distinct, joined by ``; ``."""

    def place(p: Column) -> Column:
        def written(address: Column) -> Column:
            whole = F.when(kind(address) == "OBJECT", p).otherwise(address)
            members = F.array(*[member(address, k) for k in rules.ADDRESS_KEYS], whole)
            return let(F.transform(members, as_text), chosen)

        def chosen(texts: Column) -> Column:
            parts = F.array_join(F.filter(F.slice(texts, 1, 3), lambda t: t != ""), ", ")
            return F.when(parts != "", parts).otherwise(F.get(texts, F.lit(3)))

        return let(F.coalesce(F.when(kind(p) == "OBJECT", member(p, "address")), p), written)

    places = F.when(kind(value) == "ARRAY", elements(value)).otherwise(F.array(value))
    places = F.filter(places, lambda p: filled(p).isNotNull())
    names = F.filter(F.transform(places, place), lambda t: t != "")
    return F.when(value.isNull(), "").otherwise(F.array_join(F.array_distinct(names), "; "))


def salary_of(value: Column) -> Column:
    """Salary text of a monetary amount given as object, number or text."""
    amount = member(value, "value")

    def bound(v: Column) -> Column:
        return F.when(kind(v) != "VOID", v.try_cast("string"))

    ranged = kind(amount) == "OBJECT"
    low = F.when(ranged, F.coalesce(member(amount, "minValue"), member(amount, "value"))).otherwise(amount)
    texts = F.transform(F.array(value, member(value, "currency"), member(amount, "unitText")), as_text)
    return let(
        texts,
        lambda t: F.when(
            kind(value) == "OBJECT",
            salary_text(bound(low), bound(member(amount, "maxValue")), F.get(t, F.lit(1)), F.get(t, F.lit(2))),
        ).otherwise(F.get(t, F.lit(0))),
    )


def months_as_years(months: Column) -> Column:
    """``m/12`` in compact form with up to six digits, as ``3+ years``; NULL when missing, zero or not a number."""
    number = months.try_cast("string").try_cast("double")
    years = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", number / 12), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number != 0, F.concat(years, F.lit("+ years")))


def is_posting(value: Column) -> Column:
    """Is ``@type`` the posting type, or a list that contains it?"""
    t = member(value, "@type")
    return F.coalesce(
        F.when(kind(t) == "ARRAY", F.exists(elements(t), lambda x: F.coalesce(x.try_cast("string"), F.lit("")) == "JobPosting"))
        .otherwise(t.try_cast("string") == "JobPosting"),
        F.lit(False),
    )


@lru_cache(maxsize=1)
def _objects_lambda() -> str:
    """Items are values still to be opened or objects already met, which stay where they are in document order."""
    def item(v: str, met: bool) -> str:
        return f"named_struct('v', {v}, 'met', {str(met).lower()})"

    graph = "try_variant_get(x.v, '$[\"@graph\"]', 'variant')"
    none = f"filter(array({item('x.v', True)}), f -> false)"
    step = f"""CASE WHEN x.met THEN array(x) ELSE CASE {_kind_sql("x.v")}
        WHEN 'ARRAY' THEN transform(try_variant_get(x.v, '$', 'array<variant>'), e -> {item('e', False)})
        WHEN 'OBJECT' THEN CASE WHEN {graph} IS NULL THEN array({item('x.v', True)})
          ELSE array({item('x.v', True)}, {item(graph, False)}) END
        ELSE {none} END END"""
    items = _until_closed(f"array({item('d.doc', False)})", _levels_sql("d.text"), step, "NOT x.met")
    return f"d -> transform(filter({items}, o -> o.met), o -> o.v)"


def objects(text: Column) -> Column:
    """Every object reached from a JSON text through lists and ``@graph`` members, in document order."""
    return apply_sql(F.struct(text.alias("text"), F.try_parse_json(text).alias("doc")), _objects_lambda())


def let_last_key_win(spark) -> None:
    """Read an object with a repeated key by its last value, instead of giving up on the whole text."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
