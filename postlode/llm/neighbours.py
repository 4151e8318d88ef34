"""Nearest neighbours by multiprobe p-stable hashing.

A table's hash of a unit vector is its projections on ``m`` random Gaussian directions, shifted and cut into cells of
width ``WIDTH``.  ``m`` follows from the number of vectors, so that a bucket holds about ``OCCUPANCY`` of them.  A query
visits perturbed buckets in the order of their estimated success: the probability that a neighbour at cosine ``NEAR``, whose
projections scatter around the query's, falls into the cell.  It goes on until the visited buckets have ``REACH`` of that
probability.  Candidates of all tables are merged and ranked by their exact cosine.

Equal vectors are one class, of which the smallest ids suffice for any answer, so copies never fill a bucket.  Buckets
that are large all the same are met block by block: blocks of candidates against blocks of queries, each bounded.

Defined cases: vectors that are missing, zero, or hold missing or non-finite components take no part; vectors are
compared with those of their own length; a row repeated in full counts once; a query's own row is every row with its id.  A
query for which the visited buckets hold too few candidates is compared with all vectors, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlode.session import cut

TOP = 5
TABLES = 2
WIDTH = 1.2
OCCUPANCY = 256
NEAR = 0.3
REACH = 0.85
CANDIDATES = 2_000  # of a block
QUERIES = 500       # of a block
SPARE = 8           # candidates kept above the number asked for
MARGIN = 1e-9       # far above the rounding of a cosine


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def n_directions(n: int, width: float = WIDTH, occupancy: int = OCCUPANCY) -> int:
    """Directions per table: a cell divides a normal projection into sqrt(2 pi e) / width effective parts."""
    return max(1, min(24, round(math.log(max(n / occupancy, 1.0)) / math.log(math.sqrt(2 * math.pi * math.e) / width))))


class Hashes:
    def __init__(self, m: int, tables: int = TABLES, width: float = WIDTH, near: float = NEAR, reach: float = REACH, seed: int = 17) -> None:
        self.m, self.tables, self.width, self.near, self.reach, self.seed = m, tables, width, near, reach, seed

    def projections(self, unit: np.ndarray) -> np.ndarray:
        """Shape (vectors, tables, m), in cells; the directions follow from the vectors' length."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        a = rng.normal(size=(unit.shape[1], self.tables * self.m))
        return (unit @ a).reshape(len(unit), self.tables, self.m)

    def shifts(self, d: int) -> np.ndarray:
        return np.random.default_rng([self.seed + 1, d]).uniform(0, self.width, (self.tables, self.m))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return np.floor((self.projections(unit) + self.shifts(unit.shape[1])) / self.width).astype(int)

    def probes(self, projection: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Cells in the order of their success probability, until ``reach`` of it is visited."""
        spread = math.sqrt(1 - self.near**2)
        lows, sides = np.floor((projection * self.near - 5 * spread + shift) / self.width).astype(int), []
        for mu, s, low in zip(projection * self.near, shift, lows):
            cells = [(low + k) for k in range(int(10 * spread / self.width) + 2)]
            edges = [0.5 * (1 + math.erf((c * self.width - s - mu) / (spread * math.sqrt(2)))) for c in [*cells, cells[-1] + 1]]
            sides.append(sorted(((b - a, int(c)) for c, a, b in zip(cells, edges, edges[1:])), reverse=True))
        first = (0,) * self.m
        heap, seen, visited = [(-math.prod(s[0][0] for s in sides), first)], {first}, 0.0
        while heap and visited < self.reach:
            p, at = heapq.heappop(heap)
            visited -= p
            yield tuple(s[i][1] for s, i in zip(sides, at))
            for k in range(self.m):
                if at[k] + 1 < len(sides[k]):
                    follow = (*at[:k], at[k] + 1, *at[k + 1:])
                    if follow not in seen:
                        seen.add(follow)
                        heapq.heappush(heap, (-math.prod(s[i][0] for s, i in zip(sides, follow)), follow))


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector in a batch."""
    sizes = np.array([len(v) for v in vectors])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = np.array([vectors.iloc[i] for i in rows], dtype=float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(rows: DataFrame, hashes: Hashes, probing: bool) -> DataFrame:
    """``rows`` (id, vector) once per bucket: its own in every table, or all that a query visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows_, unit in _by_length(batch["vector"]):
                d = unit.shape[1]
                shift = hashes.shifts(d)
                place = hashes.projections(unit) if probing else hashes.cells(unit)
                for row, at in zip(rows_, place):
                    found = [f"{d}:{t}:" + ",".join(map(str, c)) for t in range(hashes.tables) for c in (hashes.probes(at[t], shift[t]) if probing else [at[t]])]
                    yield pd.DataFrame({"id": batch["id"].iloc[row], "bucket": found})

    return rows.mapInPandas(run, "id bigint, bucket string")


def _levelled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines keep every bit."""
    return np.ldexp(x, -np.clip(np.frexp(np.abs(x).max(axis=1, keepdims=True))[1], -1000, 1000))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``x`` and that of ``y``, summed in the order of ``cosine``, so equal to it in every bit."""
    x, y = _levelled(x), _levelled(y)

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(a * b, axis=1)[:, -1]

    with np.errstate(all="ignore"):
        return np.fmax(-1.0, np.fmin(1.0, dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))))


def best_of_blocks(queries: DataFrame, candidates: DataFrame, top: int) -> DataFrame:
    """For (id, bucket, vector), queries with ``least``, candidates with ``low``: per query and block the ``top`` nearest
    candidate classes, and of these only those whose score is ``least`` or more.

    Classes of equal cosine are taken by their smallest vec_id, ``low``: all within a margin of the last one are ordered by
    the exact score.
    Candidates of a bucket are dealt to blocks by a hash, and so are its queries; each block meets each.
    """
    def sizes(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    n = cut(sizes(queries, QUERIES, "nq").join(sizes(candidates, CANDIDATES, "nc"), "bucket"), "ann-blocks")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(n, "bucket").withColumn("b" + own, F.pmod(F.xxhash64("id"), F.col("n" + own)).cast("int"))
        return rows.withColumn("b" + other, F.explode_outer(F.sequence(F.lit(0), F.col("n" + other) - 1))).select("bucket", "bq", "bc", "id", "vector", "low" if own == "c" else "least")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "class": [], "low": [], "near": []})
        given = [np.array(list(v["vector"]), dtype=float) for v in (q, c)]
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in given)
        near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        k = min(top, len(y))
        last = np.partition(near, len(y) - k, axis=1)[:, len(y) - k]
        low, wanted, chosen = c["low"].to_numpy(), q["least"].to_numpy(), []
        for row, least in enumerate(np.maximum(last, wanted) - MARGIN):
            at = np.flatnonzero(near[row] >= least)
            score = exact(given[0][[row]], given[1][at])
            order = np.lexsort((low[at], -score))[:k]
            order = order[score[order] >= wanted[row]]
            chosen.append((at[order], score[order]))
        best = np.concatenate([at for at, _ in chosen])
        return pd.DataFrame({"query": np.repeat(q["id"].to_numpy(), [len(at) for at, _ in chosen]), "class": c["id"].to_numpy()[best], "low": low[best], "near": np.concatenate([s for _, s in chosen])})

    keys = ["bucket", "bq", "bc"]
    return dealt(queries, "q", "c").groupBy(*keys).cogroup(dealt(candidates, "c", "q").groupBy(*keys)).applyInPandas(meet, "query bigint, class bigint, low bigint, near double")


def cosine(a: Column, b: Column) -> Column:
    def levelled(v: Column) -> Column:
        largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
        factor = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.log2(largest)))))
        return F.transform(v, lambda x: x.cast("double") * factor)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    a, b = levelled(a), levelled(b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))))


def search(vectors: DataFrame, is_query: Column, top: int = TOP, **settings) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows found for each query row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct(), "ann-rows")
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("low"), F.min(F.xxhash64("vector")).alias("h"), F.max("asks").alias("asks"))
    classes = cut(classes.withColumn("id", F.xxhash64("h", "low", F.size("vector"))), "ann-classes")
    size = classes.count()
    hashes = Hashes(n_directions(size), **settings)

    index = hashed(classes.select("id", "vector"), hashes, probing=False).join(classes.select("id", "vector", "low"), "id")
    asked = classes.where("asks").select("id", "vector")
    visits = hashed(asked, hashes, probing=True).join(asked, "id")
    spare = top + SPARE
    index = cut(index, "ann-index")

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("query", "class", "low").agg(F.max("near").alias("near"))

    # A query's own buckets first.  Of all others it wants only what is no worse than the last of the best found there.
    nearest = Window.partitionBy("query").orderBy(F.col("near").desc(), "low")
    home = hashed(asked, hashes, probing=False).join(asked, "id").withColumn("least", F.lit(-2.0))
    home = cut(merged(best_of_blocks(cut(home, "ann-home"), index, spare)), "ann-home-found")
    least = home.withColumn("r", F.row_number().over(nearest)).where(F.col("r") == spare).select(F.col("query").alias("id"), F.col("near").alias("least"))
    visits = visits.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    found = cut(merged(home.union(best_of_blocks(cut(visits, "ann-visits"), index, spare))), "ann-found")

    counts = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(spare, size))
    short = cut(asked.join(counts, asked["id"] == counts["query"], "left_anti"), "ann-short")
    if not short.isEmpty():
        length = F.size("vector").cast("string").alias("bucket")
        more = best_of_blocks(short.select("id", length, "vector", F.lit(-2.0).alias("least")), classes.select("id", length, "vector", "low"), spare)
        found = found.union(more.groupBy("query", "class", "low").agg(F.max("near").alias("near"))).distinct()

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("near").desc(), "low"))
    kept = found.withColumn("r", rank).where(F.col("r") <= spare).select("query", "class").distinct()
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = rows.withColumn("r", first).where(F.col("r") <= top + 1).join(classes.select("id", "vector"), "vector").select(F.col("id").alias("class"), "vec_id", "vector")
    queries = rows.where("asks").join(classes.select("id", "vector"), "vector").select(F.col("id").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))
    pairs = kept.join(cut(members, "ann-members"), "class").join(cut(queries, "ann-queries"), "query").where("vec_id != query_id")
    scored = pairs.groupBy("query_id", "vec_id").agg(F.max(cosine(F.col("asked"), F.col("vector"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
