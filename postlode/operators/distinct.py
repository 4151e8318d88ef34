"""Keep the first row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def distinct_first(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """First row of each key in ``order``.

    Spark keeps one row per key in every input partition before it shuffles (WindowGroupLimit), so a key that
    holds a large share of the rows sends at most one row per partition to its task.
    """
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")
