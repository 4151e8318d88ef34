"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlode.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(name: str = "text") -> Column:
    """The text of a row, where a missing text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """A 128-bit handle of one (doc_id, text), never NULL.  Rows repeated in full share it."""
    return [
        F.xxhash64(doc_id, F.isnull(doc_id), text).alias("k1"),
        F.xxhash64(text, F.lit(1), doc_id, F.isnull(text)).alias("k2"),
    ]


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of a narrow table 0, 1, 2, ... as ``pos`` in a total order, without one task seeing them all.

    The rows are dealt by range and sorted inside each range; only one count per range meets in a single task.
    """
    local = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    local = local.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = local.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per range, so its size is bounded by the number of shuffle partitions.
    return local.join(F.broadcast(starts), "_range").withColumn("pos", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")
