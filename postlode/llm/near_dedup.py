"""MinHash near-duplicate detection with tensored banding.

A text's set is its distinct shingles of five words.  Instead of many independent bands, two collections of ``HALVES`` short
keys are computed, each key the combination of ``ROWS`` minima, and a table is formed for every pair of a key of the first and
a key of the second collection: HALVES * HALVES tables from 2 * HALVES * ROWS minhash functions.  Two sets of resemblance
``s`` meet in a table unless all keys of one collection differ, so at 0.75 one link in about ten thousand has no table
(2 * (1 - 0.75**3)**18).

Equal sets are one class from the start and are never compared.  Classes are gathered by their keys of the first collection, as far as
classes of different components still share them, in blocks of about ``BLOCK`` classes; two classes of a pair of blocks that also share a key
of the second collection meet in a table.  Before such a pair becomes a row it must pass an exact test: each class has a bitmap that holds
the parity of its shingles' hashes, and where two bitmaps differ the sets differ, so a pair whose bitmaps differ in more places than the sets of
a link may is no link.  No link is lost by that, and a group of texts that are alike but not enough makes hardly any rows.

There are three rounds.  In the first two, each class is compared with the one of another component whose bitmap is nearest, which connects
a group of near copies with one comparison for each member.  In the last round all pairs that are left are compared, except those of one
component.  No pair is confirmed twice.

Links are confirmed on the full sets, taken from whole texts.

Defined cases: a text of fewer than five words has one shingle, its words in order; a text without words (or missing)
has an empty set, is linked with nothing and is its own component.  Rows with a missing id come after all others in the choice
of a component's id, so it is missing only if no member has one.  Rows repeated in full are copies like any other; all of them
carry the same ``kept``, and ``keep_one`` leaves one row of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlode.session import cut, drop_stored, shared_dir, stored

from .common import numbered, row_key, whole_text

SHINGLE = 5
PERCENT = 75
HALVES = 18
ROWS = 3
BLOCK = 512  # classes that are compared with each other at a time
NEAREST_ROUNDS = 2

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A to Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = ~_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    starts = np.flatnonzero(start[inside])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    letters = raw[inside]
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    words = mixed(np.add.reduceat(_BYTE[letters] * powers[place], starts) + lengths.astype(np.uint64))
    n = len(words) - size + 1
    if n < 1:
        return mixed(np.array([(words * _PLACE[:len(words)]).sum() + np.uint64(len(words))], dtype=np.uint64))
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        rolled += words[j:j + n] * _PLACE[j]
    return np.unique(mixed(rolled))


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """Length in 64-bit words of the bitmaps of sets of ``n`` shingles: a power of two, 8 to 16 bits a shingle, 512 at least."""
    return np.maximum(8, 1 << np.ceil(np.log2(np.maximum(n, 1) / 8)).astype(np.int64))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles at each place.  Two bitmaps differ in at most as many places as their sets."""
    words = int(bitmap_words(np.array([len(shingles)]))[0])
    at = mixed(shingles ^ _BASE)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, ((at >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class Banding:
    """The minhash functions of the two collections."""

    def __init__(self, halves: int = HALVES, rows: int = ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.halves, self.rows = halves, rows
        self.factor = rng.integers(1, 1 << 63, 2 * halves * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.name = rng.integers(1, 1 << 63, 2 * halves, dtype=np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key per member of the first, then of the second collection."""
        lows = np.empty(len(self.factor), dtype=np.uint64)
        for a in range(0, len(shingles), 4096):
            part = (self.factor[:, None] * shingles[None, a:a + 4096]).min(axis=1)
            lows = part if a == 0 else np.minimum(lows, part)
        lows = mixed(lows).reshape(2 * self.halves, self.rows)
        out = self.name.copy()
        for r in range(self.rows):
            out = mixed(out * _BASE + lows[:, r])
        return out


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """Handle, id, size and 128-bit digest of each row's set, and the keys of both collections."""
    schema = "k1 bigint, k2 bigint, doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, a array<bigint>, b array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, doc_id, text in zip(batch["k1"], batch["k2"], batch["doc_id"], batch["text"]):
                s = shingle_set(text)
                d = np.array([mixed(s + np.uint64(1)).sum(), np.bitwise_xor.reduce(mixed(s * _BASE))], dtype=np.uint64).view(np.int64)
                keys = banding.keys(s).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64)
                rows.append((k1, k2, doc_id, len(s), d[0], d[1], keys[:banding.halves], keys[banding.halves:]))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = batch["doc_id"].to_numpy()
            yield out

    text = whole_text()
    doc_id = F.col("doc_id").cast("long")
    return docs.select(*row_key(doc_id, text), doc_id.alias("doc_id"), text.alias("text")).mapInPandas(run, schema)


class Scratch:
    """Stored tables of one run, which are removed as soon as nothing reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/near-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        return stored(df, f"{self.root}/{self.made}-{name}")

    def drop(self, *names: str, before: int) -> None:
        """Remove the tables of these names that were made before the count was ``before``."""
        for i in range(1, before + 1):
            for name in names:
                drop_stored(self.spark, f"{self.root}/{i}-{name}")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(node, key): the keys of the first collection that several classes have, of classes that share one of the second as well."""

    def shared(side: str) -> DataFrame:
        keys = nodes.select("node", F.explode_outer(side).alias("key"))
        return keys.join(cut(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-keys"), "key")

    return cut(shared("a").join(shared("b").select("node").distinct(), "node", "left_semi"), "near-shared")


def marked_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, bits) of one row of ``docs`` for each of ``nodes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["bits"] = [bitmap(shingle_set(text)).view(np.int64) for text in batch["text"]]
            yield batch

    text = whole_text()
    rows = docs.select(*row_key(F.col("doc_id").cast("long"), text), text.alias("text")).join(nodes.select("node", "k1", "k2"), ["k1", "k2"])
    return rows.dropDuplicates(["node"]).select("node", "text").mapInPandas(run, "node bigint, text string, bits array<bigint>")


CLASS = ("node", "label", "n", "b", "bits")


def blocks(shared: DataFrame, marks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """One row per block of the classes that share a key with a class of another component: key, block and an array per field."""
    known = shared.withColumn("label", F.col("node")) if labels is None else shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"))
    spread = spread.where("low < high").select("key", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    rows = known.join(spread, "key").join(marks, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.groupBy("key", "block").agg(F.collect_list(F.struct(*CLASS)).alias("m"))
    return rows.select("key", "block", *(F.flatten(f"m.{c}").alias(c) if c in ("b", "bits") else F.col(f"m.{c}").alias(c) for c in CLASS))


class Classes:
    """The classes of one block, with their bitmaps by length."""

    def __init__(self, node: np.ndarray, label: np.ndarray, n: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        self.node, self.label, self.n, self.b = node, label, n, b.reshape(len(node), -1)
        self.words = bitmap_words(n)
        self.bits, self.starts = bits.view(np.uint64), np.cumsum(self.words) - self.words

    def bitmaps(self, at: np.ndarray, words: int) -> np.ndarray:
        """The bitmaps of the classes ``at``, folded to a length: the parity at places that fall together."""
        out = np.zeros((len(at), words), dtype=np.uint64)
        for k in np.unique(self.words[at] // words):
            rows = np.flatnonzero(self.words[at] == k * words)
            for fold in range(k):
                out[rows] ^= self.bits[self.starts[at[rows], None] + fold * words + np.arange(words)]
        return out


def possible(left: Classes, right: Classes, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs that meet in a table and may be links, and how far apart their bitmaps are."""
    fit = left.label[:, None] != right.label[None]
    fit &= 100 * np.minimum(left.n[:, None], right.n[None]) >= percent * np.maximum(left.n[:, None], right.n[None])
    if same:
        fit = np.triu(fit, 1)
    if fit.size >= 1024:
        # Most pairs fail with short bitmaps already, which all pairs of large blocks are tested with at once.
        words = max(8, int(min(left.words.min(), right.words.min())) // 4)
        one, other = (c.bitmaps(np.arange(len(c.node)), words) for c in (left, right))
        apart = np.zeros(fit.shape, dtype=np.int32)
        for w in range(words):
            apart += np.bitwise_count(one[:, w, None] ^ other[None, :, w])
        fit &= (100 + percent) * apart <= (100 - percent) * (left.n[:, None] + right.n[None])
    x, y = np.nonzero(fit)
    meet = np.zeros(len(x), dtype=bool)
    for k in range(left.b.shape[1]):
        meet |= left.b[x, k] == right.b[y, k]
    x, y = x[meet], y[meet]
    if not len(x):
        return x, y, np.zeros(0)
    apart = np.zeros(len(x), dtype=np.int64)
    words = np.minimum(left.words[x], right.words[y])
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        xs, to_x = np.unique(x[rows], return_inverse=True)
        ys, to_y = np.unique(y[rows], return_inverse=True)
        one, other = left.bitmaps(xs, int(w)), right.bitmaps(ys, int(w))
        step = max(1, (1 << 20) // int(w))
        for k in range(0, len(rows), step):
            part = slice(k, k + step)
            apart[rows[part]] = np.bitwise_count(one[to_x[part]] ^ other[to_y[part]]).sum(axis=1, dtype=np.int64)
    both = left.n[x] + right.n[y]
    fit = (100 + percent) * apart <= (100 - percent) * both
    return x[fit], y[fit], apart[fit] / both[fit]


def pairs_of(found: DataFrame, nearest: bool, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (x, y) of classes that meet in a table and may be links; with ``nearest`` only each class's nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                left, right = (Classes(*(at[f"{side}_{c}"][r].values.to_numpy() for c in CLASS)) for side in "xy")
                x, y, apart = possible(left, right, at["same"][r].as_py(), percent)
                ends = left.node[x], right.node[y]
                if nearest:  # the first of each class, the nearest and smallest first
                    one, other, apart = np.concatenate(ends), np.concatenate(ends[::-1]), np.concatenate([apart, apart])
                    order = np.lexsort((other, apart, one))
                    order = order[np.diff(one[order], prepend=-1) != 0]
                    ends, apart = (one[order], other[order]), apart[order]
                yield pa.RecordBatch.from_arrays([pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64()), pa.array(apart, pa.float64())], names=["x", "y", "apart"])

    sides = (found.select("key", F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in CLASS)) for s in "xy")
    cells = next(sides).join(next(sides), "key").where("x_block <= y_block").withColumn("same", F.col("x_block") == F.col("y_block"))
    out = cells.select("same", *(f"{s}_{c}" for s in "xy" for c in CLASS)).mapInArrow(run, "x bigint, y bigint, apart double")
    if nearest:
        out = out.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("near")).select("x", F.col("near.y").alias("y"))
    return out.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose full sets resemble each other by at least ``percent``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for batch in batches:
            good = []
            for x, left, right in zip(batch["x"], batch["left"], batch["right"]):
                if x != last:
                    last, kept = x, shingle_set(left)
                other = shingle_set(right)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield batch.loc[good, ["x", "y"]]

    full = pairs.join(texts.select(F.col("node").alias("y"), F.col("text").alias("right")), "y")
    full = full.join(texts.select(F.col("node").alias("x"), F.col("text").alias("left")), "x")
    return full.select("x", "y", "left", "right").mapInPandas(run, "x bigint, y bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links``, by minima of neighbours and jumps to labels of labels."""
    both = cut(links.select("x", "y").union(links.select("y", "x")).distinct(), "near-links")
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = cut(step.join(jump, "label").select("node", F.least("label", "beyond").alias("label"), "was"), "near-labels")
        if labels.where("label != was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def connect(shared: DataFrame, marks: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(node, label) of all classes that are linked with another one, or None if there are no links."""
    links = seen = labels = None
    for turn in range(NEAREST_ROUNDS + 1):
        found = scratch.cut(blocks(shared, marks, labels), "blocks")
        pairs = pairs_of(found, turn < NEAREST_ROUNDS, percent)
        pairs = scratch.cut(pairs if seen is None else pairs.join(seen, ["x", "y"], "left_anti"), "pairs")
        scratch.drop("blocks", before=scratch.made)
        if seen is None:
            # The first round names every class that has a pair at all; later ones have no other pairs.
            shared = scratch.cut(shared.join(pairs.select(F.explode_outer(F.array("x", "y")).alias("node")).distinct(), "node", "left_semi"), "shared")
        seen = pairs if seen is None else seen.union(pairs)
        new = scratch.cut(confirmed(pairs, texts, percent), "found")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            labels = components(links)
    return labels


def near_duplicates(docs: DataFrame, banding: Banding | None = None, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: handle, id, set size, component and whether its class is the one to keep (``first``)."""
    rows = cut(signatures(docs, banding or Banding()), "near-rows")
    filled = rows.where("n_shingles > 0")
    ids = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min("k1").alias("k"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("k").asc(), F.col("d1").asc(), F.col("d2").asc()]
    classes = cut(numbered(ids, order, "near-order").select("d1", "d2", F.col("pos").alias("node"), "doc_id"), "near-classes")
    # A class has one row that stands for it: the first handle among its rows with the smallest id.
    stands = filled.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r"))
    stands = stands.select("d1", "d2", F.col("r.k1").alias("k1"), F.col("r.k2").alias("k2"))
    nodes = filled.join(stands, ["d1", "d2", "k1", "k2"]).dropDuplicates(["d1", "d2"]).join(classes.drop("doc_id"), ["d1", "d2"])
    nodes = cut(nodes.select("node", "k1", "k2", "n_shingles", "a", "b"), "near-nodes")

    # Only classes that share keys are compared, so no other text is looked at again.
    scratch = Scratch(docs.sparkSession)
    shared = shared_keys(nodes)
    held = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    texts = cut(marked_texts(docs, held), "near-texts")
    marks = cut(held.select("node", F.col("n_shingles").alias("n"), "b").join(texts.select("node", "bits"), "node"), "near-marks")
    labels = connect(shared, marks, texts, percent, scratch)

    if labels is not None:
        ends = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        ends = classes.withColumn("label", F.col("node"))
    heads = classes.select(F.col("node").alias("label"), F.col("doc_id").alias("component_id"))
    ends = ends.join(cut(heads, "near-heads"), "label").select("d1", "d2", "component_id", (F.col("label") == F.col("node")).alias("first"))
    ends = cut(ends, "near-ends")
    out = rows.select("k1", "k2", "doc_id", "n_shingles", "d1", "d2").join(ends, ["d1", "d2"], "left")
    empty = F.col("n_shingles") == 0
    return out.select("k1", "k2", "d1", "d2", "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(True)).otherwise(F.col("first")).alias("first"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest handle.  All columns stay as they are."""
    found = cut(near_duplicates(docs), "near-result")
    filled = found.where("first and n_shingles > 0")
    best = filled.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r"))
    keep = best.select("r.k1", "r.k2", F.lit(True).alias("once")).union(found.where("n_shingles = 0").select("k1", "k2", F.lit(False)).distinct())
    text = whole_text()
    rows = docs.select(*row_key(F.col("doc_id").cast("long"), text), F.struct("*").alias("row")).join(cut(keep, "near-keep"), ["k1", "k2"])
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))
    return rows.where("at = 1 or not once").select("row.*")
