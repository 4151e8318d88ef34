"""Resampling documents towards a target distribution by the importance of their word runs.

A feature is a run of one or two consecutive words; its bucket is the crc32 of its bytes modulo ``BUCKETS``.  Two passes
over the documents: the first counts the features of each bucket in the documents and in the target texts, the second
scores every document with the array of the buckets' log-ratio gains.  Bytes, words and checksums of a whole slice of
texts are handled as numpy arrays; a text is never cut.  To the score comes Gumbel noise that depends on the id alone, so the
highest scores are a draw without replacement, and a rerun draws the same documents.

The draw is a distributed quickselect over composite keys (score, id, ..., row).  Each round picks a few keys at random (those
of the smallest hash), counts exactly how many keys lie below, at and between them, and keeps only the keys between the
two that enclose the k-th.  The survivors of a round are stored, so all rounds together move little more than the first.  Only
the winners are sorted, by range, and numbered.

What meets on the driver is bounded: one row per bucket, and per round ``PIVOTS`` keys and their counts.

Defined cases: a missing text has no words; a missing id is hashed as an empty text and comes after all others in ties; rows
that agree in id and score are ordered by their number of features, then by a hash of their text; rows repeated in full
are drawn one by one.  Without target texts or without documents the counts are 0 and the formula holds as it is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlode.session import cut

from .common import numbered, whole_text

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
PIVOTS = 15
SLICE_BYTES = 1 << 21  # texts handled at once; a longer text is a slice of its own
LONG = 40  # bytes of a word that are folded side by side with other words; the rest of a longer one follows by itself

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
# After lower-casing, a word is made of 0-9, a-z and every byte of a character beyond ASCII.
_IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 registers ``state`` (not yet inverted) moved on over ``data[start:end]``, each over its own part."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, moved, falling = start[order], state[order], -length[order]
    for j in range(min(int(length.max(initial=0)), LONG)):
        open_ = int(np.searchsorted(falling, -j, "left"))  # the longer ones come first
        moved[:open_] = _CRC[(moved[:open_] ^ data[at[:open_] + j]) & 255] ^ (moved[:open_] >> np.uint32(8))
    out = np.empty_like(moved)
    out[order] = moved
    for i in np.flatnonzero(length > LONG):
        out[i] = np.uint32(zlib.crc32(data[start[i] + LONG:end[i]].tobytes(), int(out[i] ^ _ONES))) ^ _ONES
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of the texts ``data[offsets[i]:offsets[i + 1]]``, and each text's word count."""
    data = _LOWER[data]
    texts = len(offsets) - 1
    inside = _IN_WORD[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after[filled[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    state = crc_on(np.full(len(start), _ONES), data, start, end)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = state[pair]
    spaced = _CRC[(spaced ^ np.uint32(32)) & 255] ^ (spaced >> np.uint32(8))
    state_of_pair = crc_on(spaced, data, start[pair + 1], end[pair + 1])
    hashes = np.concatenate([state, state_of_pair]) ^ _ONES
    return (hashes % np.uint32(buckets)).astype(np.int64), np.concatenate([text, text[pair]]), np.bincount(text, minlength=texts)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, split so that a slice stays near ``SLICE_BYTES``."""
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def bucket_counts(df: DataFrame, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket.  A task emits one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if len(batch):
                for _, _, data, offsets in _slices(batch, "text"):
                    total += np.bincount(feature_buckets(data, offsets, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = df.select(text.cast("binary").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm, as a whole number."""
    counts = np.zeros((2, buckets), np.int64)
    both = bucket_counts(docs, whole_text(), buckets).withColumn("side", F.lit(0)).union(bucket_counts(target, whole_text(), buckets).withColumn("side", F.lit(1)))
    for bucket, n, side in both.collect():  # at most two rows per bucket
        counts[side, bucket] = n
    source, goal = counts.sum(axis=1)
    ratio = [((t + 1) * (int(source) + buckets), (s + 1) * (int(goal) + buckets)) for s, t in zip(*counts.tolist())]
    return np.array([math.floor(1000 * math.log(float(up) / float(down))) for up, down in ratio], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and ``tie`` (a hash of the text) of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in _slices(batch, "text") if len(batch) else ():
                bucket, text, words = feature_buckets(data, offsets, len(gains))
                features = np.bincount(text, minlength=end - at)
                # Sums of whole numbers far below 2 to the 53, so they are exact in doubles.
                total = np.bincount(text, gains[bucket].astype(np.float64), end - at).astype(np.int64)
                rows = batch.slice(at, end - at)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), *map(pa.array, (features, words, weight))], ["doc_id", "tie", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), whole_text().cast("binary").alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id bigint, tie bigint, n_features bigint, n_words bigint, weight bigint")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def _literal(key: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in key)})"


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> list[int]:
    """The ``k``-th smallest (from 1) value of the column ``key``, arrays of whole numbers without repeats."""
    rounds = 0
    while True:
        drawn = keys.orderBy(F.xxhash64("key", F.lit(rounds)), "key").limit(pivots)
        chosen = sorted(list(r["key"]) for r in drawn.collect())
        table = F.expr(f"array({', '.join(map(_literal, chosen))})")
        below = F.size(F.filter(table, lambda p: p < F.col("key")))
        placed = keys.withColumn("below", below).withColumn("at", F.array_contains(table, F.col("key")))
        passed = 0
        for r in sorted(placed.groupBy("below", "at").count().collect()):
            if k <= passed + r["count"]:
                break
            passed += r["count"]
        if r["at"]:
            return chosen[r["below"]]
        keys = cut(placed.where((F.col("below") == r["below"]) & ~F.col("at")).select("key"), "draw-keys")
        k, rounds = k - passed, rounds + 1


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and its rank (from 1) if it is among the ``percent`` drawn."""
    rows = cut(scored(docs, bucket_gains(docs, target, buckets), seed).withColumn("row", F.monotonically_increasing_id()), "draw-scores")
    fit = F.col("n_words") >= min_words
    k = rows.where(fit).count() * percent // 100
    out = rows.select("doc_id", "n_features", "weight", "score")
    if k == 0:
        return out.withColumn("rank", F.lit(None).cast("long"))
    parts = [-F.col("score"), F.isnull("doc_id").cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("n_features"), F.col("tie"), F.col("row")]
    key = F.array(*parts)
    last = kth_key(rows.where(fit).select(key.alias("key")), k)
    won = fit & (key <= F.expr(_literal(last)))
    winners = numbered(rows.where(won), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("tie"), F.col("row")], "draw-winners")
    ranked = winners.select("doc_id", "n_features", "weight", "score", (F.col("pos") + 1).alias("rank"))
    return ranked.union(rows.where(~won).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))
