"""Salary text from bounds, currency and pay interval."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let, text_or_empty, trim_ws

_NUMBER = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"


def _number(value: Column) -> Column:
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def _given(value: Column) -> Column:
    """NULL for a missing, empty or zero bound."""
    return F.when((value != "") & (F.coalesce(_number(value), F.lit(1.0)) != 0), value)


def _shown(value: Column) -> Column:
    return F.coalesce(F.format_number(_number(value), 0), value)


def salary_text(low: Column, high: Column, currency: Column, unit: Column) -> Column:
    """``USD 90,000-120,000 per year``; equal bounds collapse, text that is no number is kept as it is."""

    def render(given: Column) -> Column:
        lo, hi = given["low"], given["high"]
        same = F.coalesce(_number(lo) == _number(hi), lo == hi)
        amount = F.when(
            lo.isNotNull() & hi.isNotNull() & ~same, F.concat(_shown(lo), F.lit("-"), _shown(hi))
        ).otherwise(_shown(F.coalesce(lo, hi)))
        return F.concat(
            trim_ws(F.concat(given["currency"], F.lit(" "), amount)),
            F.when(given["unit"] != "", F.concat(F.lit(" per "), given["unit"])).otherwise(""),
        )

    bounds = [
        let(v.cast("string"), _given).alias(n) for v, n in ((low, "low"), (high, "high"))
    ]
    labels = [text_or_empty(currency).alias("currency"), F.lower(text_or_empty(unit)).alias("unit")]
    return F.coalesce(let(F.struct(*bounds, *labels), render), F.lit(""))
