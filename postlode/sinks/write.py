"""Spreadsheet-safe export as CSV, TSV or JSON Lines."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .. import rules
from ..schema import ARRAY_COLUMNS
from ..sources.postings import project_postings

_FORMATS = ("csv", "tsv", "json")


def infer_format(path: str, fmt: str | None = None) -> str:
    """Explicit format, else the one the extension stands for, else CSV.  Workbooks are not a Spark sink."""
    chosen = fmt.lower() if fmt else rules.EXTENSIONS.get(os.path.splitext(path)[1].lower(), "csv")
    if chosen not in _FORMATS:
        raise ValueError(f"Cannot write {chosen!r}; supported formats: {', '.join(_FORMATS)}")
    return chosen


def sheet_cell(value: Column) -> Column:
    """Text without control characters, and with an apostrophe where a sheet would see a formula."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), rules.CONTROL_CHARS, "")
    return F.when(text.rlike(rules.FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def to_sheet_rows(df: DataFrame, include_description: bool = False) -> DataFrame:
    """Export columns flattened to safe strings."""
    rows = project_postings(df, include_description)
    cells = []
    for name in rows.columns:
        value = F.col(name)
        if name in ARRAY_COLUMNS:
            value = F.array_join(value, rules.LIST_SEPARATORS.get(name, "; "))
        cells.append(sheet_cell(value).alias(name))
    return rows.select(*cells)


def cap_cells(df: DataFrame, limit: int = rules.MAX_CELL) -> DataFrame:
    """Cut every text cell to the size a workbook can hold."""
    return df.select(*[
        F.substring(name, 1, limit).alias(name) if kind == "string" else F.col(name) for name, kind in df.dtypes
    ])


def _csv_options(fmt: str) -> dict:
    return {
        "sep": "\t" if fmt == "tsv" else ",", "header": True, "escape": '"', "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }


def stored_columns(spark: SparkSession, path: str, fmt: str) -> list[str]:
    """Columns of an earlier output, read from its first record; empty when there is none."""
    try:
        if fmt != "json":
            return spark.read.options(**_csv_options(fmt)).csv(path).columns
        first = spark.read.text(path).limit(1).select(F.json_object_keys("value").alias("keys")).first()
        return first.keys if first else []
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_postings(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read back what ``write_postings`` wrote, without a pass over it to infer the schema."""
    fmt = infer_format(path, fmt)
    if fmt == "json":
        names = stored_columns(spark, path, fmt)
        return spark.read.schema(", ".join(f"{c} {'ARRAY<STRING>' if c in ARRAY_COLUMNS else 'STRING'}" for c in names)).json(path)
    # A cell is never missing in what was written; the reader takes an empty one for missing.
    return spark.read.options(**_csv_options(fmt), multiLine=True, nullValue="\x00").csv(path).na.fill("")


def write_postings(df: DataFrame, path: str, fmt: str | None = None, include_description: bool = False,
                   append: bool = False) -> int:
    """Write postings and return how many were written, counted while they are written.

    Appending keeps the rows already there, without removing duplicates against them; it is refused when the
    stored columns differ.
    """
    fmt = infer_format(path, fmt)
    rows = project_postings(df, include_description) if fmt == "json" else to_sheet_rows(df, include_description)
    if append:
        stored = stored_columns(df.sparkSession, path, fmt)
        if stored and stored != rows.columns:
            raise ValueError("Cannot append: the stored columns do not match")
    seen = Observation("written")
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite")
    if fmt == "json":
        writer.json(path)
    else:
        writer.options(**_csv_options(fmt)).csv(path)
    return seen.get["n"]
