"""Removing lines that several documents share, found with two Bloom filters.

The key of a line is the line without blanks at its ends, with A to Z in lower case; keys shorter than ``MIN_CHARS`` are not
looked at.  One pass over the documents' key hashes sets two Bloom filters, one for hashes seen once and one for hashes seen
again.  Each task fills a pair of its own; pairs are merged by ``once = a.once | b.once`` and
``twice = a.twice | b.twice | a.once & b.once``, so a key of two documents always has all its bits in ``twice``, wherever
the two were read.  A second pass asks ``twice`` about every line.  Only lines that it suspects leave their documents: their
whole keys are reduced to the smallest document id, first within each task, and a key that more than one id holds is a
repeat.  Documents without a suspected line are finished where they are.

A filter has ``BITS_PER_KEY`` bits a line, but at most ``MOST_BITS`` (32 MB), the bound of what is sent to all tasks.  Beyond some 17
million lines it fills up and more lines are suspected in vain; each costs one row of the shuffle and the result is the same.

Defined cases: a missing or empty text is one empty line; rows of one id count as one document; rows without an id count as
one document after all others; a key that stands several times in one document only stays as often as it stands.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlode.operators.skew import lookup
from postlode.session import cut

from .common import row_key, whole_text

MIN_CHARS = 10
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
PROBES = 3
SEGMENTS = 64
BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """The distinct keys of a text's lines.  On UTF-8 bytes, ``lower`` changes A to Z alone."""
    keys = dict.fromkeys(line.strip(BLANKS).lower() for line in text.split(b"\n"))
    return [key for key in keys if len(key) >= 4 * min_chars or len(key.decode()) >= min_chars]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(key, digest_size=8).digest() for key in keys), np.int64)


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each hash, a power of two of them in a filter: double hashing with its two halves."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def _has(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _positions(hashes, len(filter_) * 8):
        found &= (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _put(filter_: np.ndarray, hashes: np.ndarray) -> None:
    for at in _positions(hashes, len(filter_) * 8):
        np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))


def twice_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of hashes that more than one row of ``hashes`` (arrays without repeats) may hold."""
    width = bits // 8 // SEGMENTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            new, times = np.unique(batch.column("hashes").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            _put(twice, new[(times > 1) | _has(once, new)])
            _put(once, new)
        for s in range(SEGMENTS):
            part = slice(s * width, (s + 1) * width)
            if once[part].any():
                # Few lines set few bits of a large filter, so a part is packed.
                packed = [zlib.compress(f[part].tobytes(), 1) for f in (once, twice)]
                yield pa.RecordBatch.from_pydict({"segment": [s], "once": packed[:1], "twice": packed[1:]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(zlib.decompress(r[k]), np.uint8) for k in ("once", "twice"))
                once, twice = held.get(r["segment"], (np.zeros(width, np.uint8),) * 2)
                held[r["segment"]] = once | a, twice | b | (once & a)
        for s, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_pydict({"segment": [s], "twice": [zlib.compress(twice.tobytes(), 1)]})

    parts = hashes.mapInArrow(fill, "segment bigint, once binary, twice binary")
    merged = parts.repartition(SEGMENTS, "segment").mapInArrow(merge, "segment bigint, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # at most the filter itself
        out[r["segment"] * width:(r["segment"] + 1) * width] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def repeated_keys(suspects: DataFrame) -> DataFrame:
    """(key, first, n) of the keys that rows of more than one id hold: the smallest id and the number of rows."""
    held = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("doc_id").alias("named"), F.count("*").alias("n"))
    # Rows without an id come after all others; if no row has an id, they are one document.
    return held.where(F.col("first").isNotNull() & ((F.col("first") != F.col("last")) | (F.col("named") < F.col("n")))).select("key", "first", "n")


def without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """Each text without its lines whose keys are in its list."""
    kept, counts = [], []
    for text, keys in zip(texts.to_pylist(), dropped.to_pylist()):
        all_lines, keys = text.split(b"\n"), frozenset(keys or ())
        left = [line for line in all_lines if line.strip(BLANKS).lower() not in keys] if keys else all_lines
        kept.append(b"\n".join(left))
        counts.append(len(all_lines) - len(left))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(counts, pa.int64())], ["kept", "n_dropped"])


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the ``kept`` text of each row of ``docs``."""
    doc_id, text = F.col("doc_id").cast("long"), whole_text()
    rows = docs.select(*row_key(doc_id, text), doc_id.alias("doc_id"), text.cast("binary").alias("text"))

    def hashed(texts: pa.Array) -> pa.Array:
        found = [_hashes(line_keys(t.as_py(), min_chars)) for t in texts]
        return _lists(pa.array(np.concatenate([np.empty(0, np.int64), *found])), [len(f) for f in found])

    hashes = F.arrow_udf(hashed, "array<bigint>")(text.cast("binary"))
    narrow = cut(docs.select(hashes.alias("hashes")).where(F.size("hashes") > 0), "line-hashes")
    total = narrow.agg(F.sum(F.size("hashes"))).first()[0] or 0
    bits = min(max(LEAST_BITS, 1 << (total * BITS_PER_KEY).bit_length()), MOST_BITS)
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(narrow, bits))

    def suspected(texts: pa.Array) -> pa.Array:
        keys = [line_keys(t.as_py(), min_chars) for t in texts]
        hits = iter(_has(twice.value, _hashes([key for of_text in keys for key in of_text])))
        found = [[key for key, hit in zip(of_text, hits) if hit] for of_text in keys]
        return _lists(pa.array([key for of_text in found for key in of_text], pa.binary()), [len(f) for f in found])

    asked = rows.withColumn("keys", F.arrow_udf(suspected, "array<binary>")("text"))
    suspect = F.size("keys") > 0
    lines = asked.where(suspect).select("k1", "k2", "doc_id", "keys")
    lines = cut(lines, "line-suspects").withColumn("key", F.explode("keys")).drop("keys")
    repeated = cut(repeated_keys(lines), "line-repeats")
    # A key may stand in most documents: its rows are dealt over copies of its fact.
    found = lookup(lines, repeated, ["key"], F.col("k1")).where(F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))))
    drops = found.groupBy("k1", "k2").agg(F.collect_set("key").alias("dropped"))
    cleaned = asked.where(suspect).select("k1", "k2", "doc_id", "text").join(cut(drops, "line-drops"), ["k1", "k2"], "left")
    cleaned = cleaned.withColumn("out", F.arrow_udf(without, "struct<kept: binary, n_dropped: bigint>")("text", "dropped"))
    n_lines = F.size(F.split(F.col("text").cast("string"), "\n", -1)).cast("long").alias("n_lines")
    cleaned = cleaned.select("doc_id", n_lines, F.col("out.n_dropped"), F.col("out.kept").cast("string").alias("kept"))
    return cleaned.union(asked.where(~suspect).select("doc_id", n_lines, F.lit(0).cast("long"), F.col("text").cast("string")))
