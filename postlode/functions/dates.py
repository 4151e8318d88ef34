"""Posting dates.  ``as_of`` always stands for today; nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules
from .core import let, text_or_empty, trim_ws

_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december"]
_NAME = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else "may" for m in _MONTHS)
_MONTH_FIRST = rf"(?iU)^({_NAME})\s+(\d{{1,2}}),?\s+(\d{{4}})$"
_DAY_FIRST = rf"(?iU)^(\d{{1,2}})\s+({_NAME})\s+(\d{{4}})$"
_SLASH_YEAR_LAST = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_SLASH_YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
_MAX_DAYS = 3_000_000


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", F.try_to_date(text, "yyyy-MM-dd"))


def _month_number(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS]), F.lower(F.substring(name, 1, 3)))
    return position.cast("string")


def _written_date(text: Column) -> Column:
    """A whole string in one of the accepted written forms."""

    def parts(pattern: str) -> list[Column]:
        return [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]

    (m1, d1, y1), (d2, m2, y2) = parts(_MONTH_FIRST), parts(_DAY_FIRST)
    (m3, d3, y3), (y4, m4, d4) = parts(_SLASH_YEAR_LAST), parts(_SLASH_YEAR_FIRST)
    return (
        F.when(text.rlike(_MONTH_FIRST), _ymd(y1, _month_number(m1), d1))
        .when(text.rlike(_DAY_FIRST), _ymd(y2, _month_number(m2), d2))
        .when(text.rlike(_SLASH_YEAR_LAST), _ymd(y3, m3, d3))
        .when(text.rlike(_SLASH_YEAR_FIRST), _ymd(y4, m4, d4))
    )


def parse_date(value: Column, as_of: Column) -> Column:
    """Day meant by ``value``: ISO, relative ("3 days ago") or written; NULL when none can be read."""

    def read(text: Column) -> Column:
        iso = F.regexp_extract(text, rules.ISO_DATE, 0)
        low = F.lower(text)
        count = F.regexp_extract(low, rules.RELATIVE_DATE, 1).try_cast("bigint")
        unit = F.regexp_extract(low, rules.RELATIVE_DATE, 2)
        factor = F.lit(0)
        for name, days in rules.UNIT_DAYS.items():
            if days:
                factor = F.when(unit == name, days).otherwise(factor)
        back = F.when(count <= _MAX_DAYS, count * factor)
        cleaned = F.regexp_replace(F.regexp_replace(text, rules.POSTED_PREFIX, ""), rules.ORDINAL, "$1")
        cleaned = F.replace(cleaned, F.lit("."), F.lit(""))
        candidates = let(
            cleaned,
            lambda c: F.concat(F.array(c), F.regexp_extract_all(c, F.lit(rules.EMBEDDED_DATE), F.lit(0))),
        )
        written = F.array_compact(F.transform(candidates, lambda c: _written_date(trim_ws(c))))
        return (
            F.when(text == "", F.lit(None).cast("date"))
            .when(iso != "", _ymd(F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)))
            .when(low.rlike(rules.TODAY_WORDS), as_of)
            .when(low.contains("yesterday"), F.date_sub(as_of, 1))
            .when(
                unit != "",
                F.when(back < F.datediff(as_of, F.lit("0001-01-01").cast("date")), F.date_sub(as_of, back.cast("int"))),
            )
            .otherwise(F.get(written, F.lit(0)))
        )

    return let(trim_ws(text_or_empty(value)), read)


def normalize_date(value: Column, as_of: Column) -> Column:
    """ISO text of the date, or the trimmed original when it cannot be read."""
    return F.coalesce(F.date_format(parse_date(value, as_of), "yyyy-MM-dd"), trim_ws(text_or_empty(value)))


def date_from_epoch(value: Column, millis: bool = False) -> Column:
    """UTC day of an epoch number as ISO text; empty when it is not a number."""
    per_day = 86_400_000 if millis else 86_400
    number = F.when(value.rlike(r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"), value.try_cast("double"))
    days = F.floor(number / per_day)
    in_range = days.between(-719_162, 2_932_896)
    day = F.when(in_range, F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))
