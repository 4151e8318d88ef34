"""Fill the derived fields of postings from their description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.core import text_or_empty
from ..functions.dates import normalize_date
from ..functions.detect import (
    detect_certifications, detect_clearance, detect_education, detect_experience, detect_remote,
)
from ..functions.text import extract_requirements, summarize
from ..schema import UNKNOWN


def enrich(df: DataFrame, as_of: Column, summary_chars: int = rules.SUMMARY_CHARS) -> DataFrame:
    """Set each derived field that is still empty; the date is normalised always.

    One projection: a field that neither the filter nor the output needs is pruned with all its patterns.
    """
    text = text_or_empty(F.col("description"))

    def blank(name: str, value: Column) -> Column:
        return F.when(F.col(name) != "", F.col(name)).otherwise(value)

    def no_items(name: str, value: Column) -> Column:
        return F.when(F.size(name) > 0, F.col(name)).otherwise(value)

    return df.withColumns({
        "posted_date": normalize_date(F.col("posted_date"), as_of),
        "summary": blank("summary", summarize(text, summary_chars)),
        "education": blank("education", detect_education(text)),
        "certifications": no_items("certifications", detect_certifications(text)),
        "experience": blank("experience", detect_experience(text)),
        "clearance": no_items("clearance", detect_clearance(text)),
        "requirements": no_items("requirements", extract_requirements(text)),
        "remote": F.when(
            F.col("remote") == UNKNOWN, detect_remote(F.col("title"), F.col("location"), text, F.col("tags"))
        ).otherwise(F.col("remote")),
    })
