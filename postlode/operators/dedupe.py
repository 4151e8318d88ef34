"""Exact removal of duplicate postings.

Rule, in posting order: a row is dropped when its URL key belongs to a row already kept, or when its title and
company belong to a row already kept from another source.  Dropped rows claim nothing.

Two rows conflict when they share a URL key, or share a title key and come from different sources; the result is
the first maximal independent set of that conflict graph.  It is found in rounds.  In each round every undecided
row that is the earliest among its undecided rivals is kept, and the rivals of kept rows are dropped.  A round is
grouped minima and equality joins over narrow key rows, so no group of duplicates is ever brought together in one
task, and rows are first reduced to one node per (URL, title, source), which is all a group of copies can be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import text_or_empty, trim_ws
from ..functions.urls import url_key
from ..session import cut
from .skew import HOT_ROWS, lookup


def title_key(title: Column, company: Column) -> Column:
    """Key of title and company; NULL without a company."""
    who = F.lower(trim_ws(text_or_empty(company)))
    return F.when(who != "", F.concat(F.lower(trim_ws(text_or_empty(title))), F.lit("|"), who))


def posting_keys(df: DataFrame, order_by: str, row_id: str | None = None) -> DataFrame:
    """``(ord, u, t, s)``: order, URL key, title key, source.

    Rows of equal ``order_by`` are told apart by a hash of their keys, and copies by ``row_id``.
    """
    u, s = url_key(F.col("url")), text_or_empty(F.col("source"))
    t = title_key(F.col("title"), F.col("company"))
    ties = [F.xxhash64("url", "title", "company", "source").alias("h")] + ([F.col(row_id).alias("id")] if row_id else [])
    return df.select(F.struct(F.col(order_by).alias("at"), *ties).alias("ord"), u.alias("u"), t.alias("t"), s.alias("s"))


def key_nodes(keys: DataFrame) -> DataFrame:
    """One node per (URL, title, source), with the number ``rows`` it stands for.

    With a URL the earliest row stands for all: a later copy can only be dropped.  Without one, rows of one title
    and source never rival each other and all share the fate of the earliest.  Rows with neither key are left out;
    they are always kept.
    """
    keyed = keys.where(F.col("u").isNotNull() | F.col("t").isNotNull())
    return keyed.groupBy("u", "t", "s").agg(F.min("ord").alias("ord"), F.count("*").alias("rows"))


def _leads(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per URL its first node; per title its leading source and where the first rival source comes in."""
    by_url = nodes.where("u IS NOT NULL").groupBy("u").agg(F.min("ord").alias("u_first"), F.count("*").alias("n"))
    by_source = nodes.where("t IS NOT NULL").groupBy("t", "s").agg(
        F.min("ord").alias("ord"), F.count("*").alias("n")
    )
    # Two smallest (order, source) pairs of a title without collecting its sources: the least overall, then the
    # least among rows that are not it.
    least = by_source.groupBy("t").agg(
        F.min(F.struct("ord", "s")).alias("lead"), F.sum("n").alias("n"), F.count("*").alias("sources")
    )
    contested = least.where("sources > 1").select("t", "lead")
    rival = by_source.join(contested, "t").where("s <> lead.s").groupBy("t").agg(F.min("ord").alias("rival"))
    by_title = least.join(rival, "t", "left").select("t", F.col("lead.s").alias("lead_s"), "rival", "n")
    return by_url, by_title


def _lead_nodes(nodes: DataFrame, hot_rows: int) -> DataFrame:
    """Undecided nodes with ``keep`` set on those that no undecided rival precedes."""
    by_url, by_title = _leads(nodes)
    seen = lookup(nodes, by_url, ["u"], F.col("ord"), hot_rows)
    seen = lookup(seen, by_title, ["t"], F.col("ord"), hot_rows)
    first_url = F.col("u").isNull() | (F.col("ord") == F.col("u_first"))
    leads_title = F.col("t").isNull() | (
        (F.col("s") == F.col("lead_s")) & (F.col("rival").isNull() | (F.col("ord") < F.col("rival")))
    )
    return seen.select("ord", "u", "t", "s", "rows", (first_url & leads_title).alias("keep"))


def _drop_rivals(marked: DataFrame, hot_rows: int) -> DataFrame:
    """Set ``drop`` on the rivals of the nodes kept in this round."""
    urls = marked.where("u IS NOT NULL").groupBy("u").agg(
        F.bool_or("keep").alias("u_kept"), F.count("*").alias("n")
    ).where("u_kept")
    owners = marked.where("t IS NOT NULL").groupBy("t").agg(
        F.min(F.when(F.col("keep"), F.col("s"))).alias("owner"), F.count("*").alias("n")
    ).where("owner IS NOT NULL")
    seen = lookup(marked, urls, ["u"], F.col("ord"), hot_rows)
    seen = lookup(seen, owners, ["t"], F.col("ord"), hot_rows)
    rival = F.coalesce(F.col("u_kept"), F.lit(False)) | F.coalesce(F.col("owner") != F.col("s"), F.lit(False))
    return seen.select("ord", "u", "t", "s", "rows", "keep", (~F.col("keep") & rival).alias("drop"))


def dropped_nodes(nodes: DataFrame, left: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes the rule drops, found in rounds over stored tables; ``left`` is how many there are.

    Orders are unique, so the earliest undecided node is kept in every round and each round makes progress.
    """
    settled: list[DataFrame] = []
    rest = nodes
    while left:
        marked = cut(_lead_nodes(rest, hot_rows), "dedupe-leads")
        decided = cut(_drop_rivals(marked, hot_rows), "dedupe-round")
        settled.append(decided.where("drop").select("ord", "u", "t", "s", "rows"))
        rest = decided.where("NOT keep AND NOT drop").drop("keep", "drop")
        before, left = left, rest.count()
        if left >= before:
            raise RuntimeError("a dedupe round decided nothing: the order of postings is not unique")
    return reduce(DataFrame.unionByName, settled) if settled else nodes.limit(0)


def dedupe_postings(df: DataFrame, order_by: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` without duplicate postings; ``order_by`` decides who comes first, and ties are broken by a hash.

    The rows are stored once under an id of their own.  Everything is decided on keys, and the ids that the rule drops
    are taken out of the stored rows.
    """
    rows = cut(df.withColumn("_row_id", F.monotonically_increasing_id()), "dedupe-rows")
    keys = posting_keys(rows, order_by, "_row_id")
    nodes = cut(key_nodes(keys), "dedupe-nodes")
    dropped = dropped_nodes(nodes, nodes.count(), hot_rows)
    kept = nodes.where("u IS NOT NULL").select("ord").join(dropped.select("ord"), "ord", "left_anti")
    gone = keys.where("u IS NOT NULL").select("ord").join(kept, "ord", "left_anti")
    # Rows without a URL follow the verdict on their title and source.
    lost = dropped.where("u IS NULL").select("t", "s", F.lit(True).alias("lost"), F.col("rows").alias("n"))
    judged = lookup(keys.where("u IS NULL"), lost, ["t", "s"], F.col("ord"), hot_rows)
    gone = gone.unionByName(judged.where("lost").select("ord"))
    gone = cut(gone.select(F.col("ord.id").alias("_row_id")), "dedupe-gone")
    return rows.join(gone, "_row_id", "left_anti").drop("_row_id")
