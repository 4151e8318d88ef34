"""Small Column helpers shared by the other function modules.

Every helper stays inside the JVM: no Python runs per row anywhere in this package.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Unicode white space plus the separators U+001C..U+001F, and the subset that ends a line.
WS = r"\s\x1c-\x1f"
BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` by name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_text(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_sql(value: Column, function: str) -> Column:
    """Apply a SQL lambda such as ``v -> upper(v)`` to a value.

    Long expressions are written this way because Spark parses them in one step; built call by call from Python
    they would take longer to construct than a small query takes to run.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[let(v, lambda x: F.when(x != "", x)) for v in values], F.lit(""))


def trim_ws(value: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(value, rf"(?U)^[{WS}]+|[{WS}]+\z", "")


def trim_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def split_lines(value: Column) -> Column:
    return F.split(value, f"[{BREAKS}]")


def at_least_words(value: Column, n: int) -> Column:
    """Does ``value`` hold ``n`` or more white-space separated words?  Stops reading at the n-th."""
    return value.rlike(rf"(?U)^[{WS}]*(?:[^{WS}]+[{WS}]+){{{n - 1}}}[^{WS}]")


def fold_case(value: Column) -> Column:
    """Text with upper and lower case made equal the way case-insensitive patterns compare them."""
    return F.lower(F.upper(F.replace(value, F.lit("\u0130"), F.lit("i"))))


def holds_any(folded: Column, pieces: list[str]) -> Column:
    """Does case-folded text contain one of the pieces?  A byte search, many times faster than a pattern."""
    return reduce(lambda a, b: a | b, [folded.contains(p) for p in pieces])


def tidy_array(value: Column) -> Column:
    """Array of strings without NULL elements; NULL becomes the empty array."""
    return F.coalesce(F.array_compact(value), F.array().cast("array<string>"))


def unnest(df: DataFrame, kept: list, items: Column, item: str, pos: str = "_pos") -> DataFrame:
    """One row per array element with its position.

    An inner explode makes the optimizer add a filter on the array's size and move it down, which computes a
    costly array three times over.  The outer form is left alone; rows from empty arrays are dropped after it.
    """
    return df.select(*kept, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def keep_rows(df: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """``df.where`` for conditions on costly computed columns.

    The optimizer moves a plain filter below the projection that computes its columns, which evaluates them once
    for the filter and once more for the output.  Here every column is computed once and then tested.
    """
    kept = unnest(df, [], F.filter(F.array(F.struct(*df.columns)), condition), "_row")
    return kept.select("_row.*")


def empty_array() -> Column:
    return F.array().cast("array<string>")
