"""Mixing sources to target weights by the cube method.

Sources in code point order (missing last) weigh 5, 2, 1, repeating, and share the total size of all documents; a target
stops at ``MOST`` times its source's size, and the excess is shared anew by weight until no target is above.  A document
is taken ``floor(target / source size)`` times, and once more with the remaining probability.

Those once-more decisions are a balanced sample.  In each block of a source the flight phase moves the inclusion
probabilities through the null space of two constraints, the number of documents and the number of words, so that
both totals stay as they are while one document after another is decided.  At most a few documents per block stay open;
they meet again in blocks of the next level, until one block per source is left.  What is open then, the landing
problem, is at most two documents per source: either each is taken in part, so that the words taken meet the target, or
whole, in the combination that comes nearest to it.

Nothing but ids, sources and sizes is moved.  Blocks and random numbers follow from hashes, so that reruns agree.

Defined cases: a missing text has size 0 and nothing is taken from it; rows that agree in id, source and size are decided
together; without words all targets are 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlode.session import cut

from .common import numbered, row_key, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 1000
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``target`` of each row (source, source_size): shares by weight, none above ``most`` times the source's size."""
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "mix-sources")
    table = F.array(*[F.lit(w) for w in weights])
    placed = cut(placed.select("source", "source_size", F.get(table, F.pmod("pos", F.lit(len(weights))).cast("int")).alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "mix-weights")
    total = float(placed.agg(F.sum("source_size")).first()[0] or 0)
    level, before = None, -1.0
    while level is None or level > before:
        before = -1.0 if level is None else level
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        held, open_ = placed.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            break
        level = max(total - (held or 0.0), 0.0) / open_
    return placed.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level or 0.0)).alias("target"))


def _null_vector(a: np.ndarray) -> np.ndarray | None:
    """A vector that the rows of ``a`` (two by two or two by three) map to nothing."""
    n = a.shape[1]
    if n == 3:
        u = np.cross(a[0], a[1])
        if np.abs(u).max() > EDGE * max(1.0, np.abs(a).max() ** 2):
            return u / np.abs(u).max()
    for i in range(n):
        for j in range(i):
            cross = a[0, i] * a[1, j] - a[0, j] * a[1, i]
            if abs(cross) <= EDGE * max(1.0, np.abs(a).max() ** 2):
                u = np.zeros(n)
                u[i], u[j] = (a[0, j], -a[0, i]) if a[0].any() else (a[1, j], -a[1, i])
                if u.any():
                    return u / np.abs(u).max()
    return None


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` to 0 or 1 with ``x.T @ p`` unchanged, three units at a time; at most as many as constraints stay open."""
    p = p.astype(float).copy()
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    x = x / scale
    waiting = list(np.flatnonzero((p > EDGE) & (p < 1 - EDGE))[::-1])
    held: list[int] = []
    while True:
        while waiting and len(held) < 3:
            held.append(waiting.pop())
        u = _null_vector(x[held].T) if len(held) > 1 else None
        if u is None:
            return p
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        q[q < EDGE], q[q > 1 - EDGE] = 0.0, 1.0
        p[held] = q
        held = [h for h, v in zip(held, q) if 0 < v < 1]


def landing(p: np.ndarray, words: np.ndarray, partial: bool) -> np.ndarray:
    """Decide the open units: in part as ``p`` says, or whole in the combination nearest to the words expected."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if partial or not len(open_):
        return p
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(words[k] * ((m >> i & 1) - p[k]) for i, k in enumerate(open_))), m))
    p = p.copy()
    p[open_] = [best >> i & 1 for i in range(len(open_))]
    return p


def decide(units: DataFrame, block: int, partial: bool) -> DataFrame:
    """``p`` of each unit moved to 0 or 1, level by level."""
    schema = "unit string, source string, words double, rows double, p double, last boolean"

    def level(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit", ignore_index=True)
        rng = np.random.default_rng(zlib.crc32(f"{len(group)} {group['unit'][0]} {group['p'].sum():.9f}".encode()))
        group["p"] = flight(group["p"].to_numpy(), group[["rows", "words"]].to_numpy(), rng)
        if group["last"][0]:
            group["p"] = landing(group["p"].to_numpy(), group["words"].to_numpy(), partial)
        return group[["unit", "source", "words", "rows", "p", "last"]]

    # Flight leaves alone what is decided but for rounding, so nothing like it may wait for a level that decides it.
    p = F.col("p")
    done, left = [], units.withColumn("p", F.when(p <= EDGE, 0.0).when(p >= 1 - EDGE, 1.0).otherwise(p))
    while True:
        counts = left.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks"))
        counts = cut(counts, "mix-blocks")
        dealt = left.join(counts, left["source"].eqNullSafe(counts["source"])).select(left["*"], "blocks")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(len(done))), F.col("blocks"))).withColumn("last", F.col("blocks") == 1)
        moved = cut(dealt.groupBy("source", "block").applyInPandas(level, schema), "mix-moved")
        open_ = (F.col("p") > 0) & (F.col("p") < 1) & ~F.col("last")
        done.append(moved.where(~open_).select("unit", "p"))
        left = moved.where(open_).drop("last")
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, partial: bool = True) -> DataFrame:
    """Handle, id, source, size, source_size, target and taken (words) of each row of ``docs``."""
    doc_id, text = F.col("doc_id").cast("long"), whole_text()
    rows = docs.select(*row_key(doc_id, text), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"))
    rows = cut(rows, "mix-rows")
    unit = F.to_json(F.struct("doc_id", "source", "size"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    goal = cut(goal.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-targets")
    rows = cut(rows.join(goal, rows["source"].eqNullSafe(goal["_source"])).drop("_source").withColumn("unit", unit), "mix-goals")
    units = rows.where("size > 0").groupBy("unit", "source").agg(F.sum("size").cast("double").alias("words"), F.count("*").cast("double").alias("rows"), F.max(F.col("times") - F.floor("times")).alias("p"))
    decided = cut(decide(units, block, partial), "mix-decided")
    once = F.round(F.coalesce("p", F.lit(0.0)) * F.col("size")).cast("long")
    taken = F.floor("times").cast("long") * F.col("size") + once
    return rows.join(decided, "unit", "left").select("k1", "k2", "doc_id", "source", "size", "source_size", "target", F.least(taken, F.col("size") * most).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it whole.  Texts without words are left out."""
    mixed = mix(docs, weights, most, partial=False)
    times = mixed.where("size > 0 and taken > 0").groupBy("k1", "k2").agg(F.max(F.expr("taken div size")).cast("int").alias("times"))
    text = whole_text()
    rows = docs.select(*row_key(F.col("doc_id").cast("long"), text), F.struct("*").alias("row")).join(cut(times, "mix-times"), ["k1", "k2"])
    return rows.withColumn("at", F.explode_outer(F.sequence(F.lit(1), F.col("times")))).select("row.*")
