"""Shape every source into the canonical posting row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import text_or_empty, tidy_array
from ..schema import ARRAY_COLUMNS, COLUMNS, SEQ_DDL, UNKNOWN

FIELDS = COLUMNS + ["description"]


def sequence_of(rank: Column, board: Column, request_no: Column, item_pos: Column) -> Column:
    return F.struct(
        rank.cast("int").alias("source_rank"),
        text_or_empty(board).alias("board"),
        request_no.cast("bigint").alias("request_no"),
        item_pos.cast("int").alias("item_pos"),
    ).cast(SEQ_DDL)


def as_postings(df: DataFrame, seq: Column, **fields: Column) -> DataFrame:
    """Select the posting columns; fields not given get the empty default, and no field is ever NULL."""
    columns = [seq.alias("seq")]
    for name in FIELDS:
        given = fields.get(name)
        if name in ARRAY_COLUMNS:
            value = F.array().cast("array<string>") if given is None else tidy_array(given)
        elif name == "remote":
            value = F.lit(UNKNOWN) if given is None else given
        else:
            value = F.lit("") if given is None else text_or_empty(given)
        columns.append(value.alias(name))
    return df.select(*columns)


def project_postings(df: DataFrame, include_description: bool = False) -> DataFrame:
    """The exported columns in their fixed order."""
    return df.select(*(FIELDS if include_description else COLUMNS))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources one after the other; the list position becomes the leading part of the order."""
    ranked = [
        df.withColumn("seq", F.col("seq").withField("source_rank", F.lit(i))) for i, df in enumerate(sources)
    ]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df)
    return out
