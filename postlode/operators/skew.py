"""Joining rows to per-key facts when one key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 100_000  # rows that one copy of a key's fact row serves


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` to ``facts``, which has one row per key and the number ``n`` of rows behind it.

    Every key with more than ``hot_rows`` rows, however many such keys there are, gets one copy of its fact row for each
    ``hot_rows`` of them, and its rows are dealt over those copies by ``spread``, a value that differs between rows.  Rows
    with a missing key have no fact and stay out of the join.
    """
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    copies = F.ceil(F.col("n") / hot_rows).cast("int")
    # There is one such key for each hot_rows rows at most; the size decides how this list is joined.
    hot = facts.where(F.col("n") > hot_rows).select(*keys, copies.alias("_copies"))
    salt = F.pmod(F.xxhash64(spread), F.coalesce("_copies", F.lit(1))).cast("int")
    dealt = rows.where(~no_key).join(hot, keys, "left").withColumn("_salt", salt).drop("_copies")
    spread_facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))).drop("n")
    found = dealt.join(spread_facts, [*keys, "_salt"], "left").drop("_salt")
    return found.unionByName(rows.where(no_key), allowMissingColumns=True)
