"""Grouping spelling variants: each word's more frequent neighbour at one inserted, deleted or replaced letter.

**Blocks.**  Two words of ``L`` and ``L`` or ``L + 1`` letters that differ by one edit agree before the edit and after it.
The first letter at which they differ (or the last of the ``L``, if only one was added at the end) lies in one of the intervals
[0, L / 2) and [L / 2, L), so the pair meets in the block of that interval: words that agree in all letters before
it and after it.  A block with more than ``BLOCK`` words is split by halving its interval, as long as there is one; at
an interval of one letter a block can hold no more words than there are letters, and pairs of letters.  So no group grows
without bound, whatever share of the words starts or ends alike, and every pair meets in exactly one block.

**Bit-sliced index.**  Inside a block, each (position, letter) has a bitset over the block's words.  For a word, recurrences move
over the positions of the interval: the words equal so far, ``zero &= index[i, c]``, those with one letter replaced,
``replaced = replaced & index[i, c] | zero & ~index[i, c]``, and those with one letter more, whose positions are shifted,
``longer = (longer | zero) & index[i + 1, c]``.  All words of a block are treated at once by each operation.  Bits stand in
the order of a form's preference (frequency, then code points), so the best near word is the lowest bit.

A block returns one row per word that has a neighbour there: how many, and the best.  Chains of forms are followed by
doubling: each round joins every word's present end to the end of that end.

Defined cases: missing and empty texts have no words; a missing id is hashed as an empty text; repeated rows count as often
as they stand; without words the result is empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlode.operators.skew import lookup
from postlode.session import cut

from .common import ascii_lower, whole_text

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS = 5
MIN_COUNT = 3
TIMES = 2
SLIP = 97
BLOCK = 4096


def words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the distinct words of all texts.  One run in ``slip``, by a hash of id and run, loses a letter."""
    # Shorter runs can't become words, and a run of at least so many letters is matched whole.
    runs = F.regexp_extract_all(ascii_lower(whole_text()), F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(h % slip == 0, slipped).otherwise(F.col("run"))
    counted = named.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars))


def _blocks(rows: DataFrame) -> Column:
    """The block of a row: word length ``L`` of the shorter words, interval and the letters before and after it."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.col("hi") + 1 + F.col("longer"), F.char_length("word"))
    return F.struct("L", "lo", "hi", before.alias("before"), after.alias("after"))


def blocked(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each word in its blocks, as one of the ``L`` letters and as one of a letter more; no block too large can be halved."""
    size = F.char_length("word")
    # A word meets words of its own length and longer ones as one of L letters, and shorter ones as one of L + 1.
    rows = vocabulary.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = rows.withColumn("L", size - F.col("longer")).where("L > 0")
    half = F.floor(F.col("L") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("L").alias("hi")))
    rows = rows.select("*", F.explode(sides).alias("side")).select("word", "n", "longer", "L", "side.lo", "side.hi").where("lo < hi")
    done = []
    while True:
        rows = cut(rows.withColumn("block", _blocks(rows)), "spelling-blocks")
        full = rows.where("hi - lo > 1").groupBy("block").agg(F.count("*").alias("n_words")).where(F.col("n_words") > block)
        full = cut(full.withColumn("full", F.lit(True)).drop("n_words"), "spelling-full")
        if full.isEmpty():
            break
        found = rows.join(full, "block", "left")
        done.append(found.where("full IS NULL").drop("full"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        sides = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        rows = found.where("full").withColumn("side", F.explode(sides)).select("word", "n", "longer", "L", "side.lo", "side.hi")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _near(words_: list[str], counts: list[int], longer: list[int], L: int, lo: int, hi: int) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, best of them, its count) of each word that has near words in its block."""
    order = sorted(range(len(words_)), key=lambda i: (-counts[i], words_[i]))
    index: dict[tuple[int, str], int] = defaultdict(int)
    is_longer = 0
    for bit, i in enumerate(order):
        is_longer |= longer[i] << bit
        for p, c in enumerate(words_[i][lo:hi + longer[i]]):
            index[p, c] |= 1 << bit
    all_, same = (1 << len(order)) - 1, ((1 << len(order)) - 1) & ~is_longer
    found: dict[int, list[int]] = {}

    def add(bit: int, n: int, best: int) -> None:
        if bit in found:
            found[bit][0] += n
            found[bit][1] = min(found[bit][1], best)
        else:
            found[bit] = [n, best]

    for bit, i in enumerate(order):
        if longer[i]:
            continue
        zero, replaced, more = all_, 0, 0
        for p, c in enumerate(words_[i][lo:hi]):
            here = index.get((p, c), 0)
            more = (more | zero) & index.get((p + 1, c), 0)
            replaced = replaced & here | zero & ~here
            zero &= here
        # Equal so far and one letter more: an addition at the very end; elsewhere the pair belongs to a later interval.
        hits = replaced & same | (more | (zero if hi == L else 0)) & is_longer
        if hi < L:
            hits &= ~zero
        if hits:
            add(bit, hits.bit_count(), (hits & -hits).bit_length() - 1)
        extra = hits & is_longer
        while extra:
            low = extra & -extra
            add(low.bit_length() - 1, 1, bit)
            extra ^= low
    for bit, (n, best) in found.items():
        yield words_[order[bit]], n, words_[order[best]], counts[order[best]]


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words: those at one edit, and the preferred one."""
    rows = blocked(vocabulary, block)
    groups = rows.groupBy("block").agg(F.collect_list(F.struct("word", "n", "longer")).alias("members")).where(F.size("members") > 1)
    groups = groups.where(F.exists("members", lambda m: m["longer"] == 0))
    groups = groups.select("block.L", "block.lo", "block.hi", "members.word", "members.n", "members.longer")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for g in batch.to_pylist() for row in _near(g["word"], g["n"], g["longer"], g["L"], g["lo"], g["hi"])]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], ["word", "n_near", "best", "best_n"])

    found = groups.mapInArrow(search, "word string, n_near bigint, best string, best_n bigint")
    # The most frequent, then the smallest: the smallest of (minus n, word).
    preferred = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), preferred.alias("p"))
    return merged.select("word", "n_near", F.col("p.best").alias("best"), (-F.col("p.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): forms followed to the last.  Frequencies double at least, so chains are short."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = cut(ends, "spelling-roots")
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # Only ends that have a form themselves lead on; many words may share one.
        held = ends.groupBy("root").agg(F.count("*").alias("n")).join(onward, "root")
        moved = cut(held, "spelling-onward")
        if moved.isEmpty():
            return ends
        ends = lookup(ends, moved, ["root"], F.col("word")).select("word", F.coalesce("next", "root").alias("root"))


def group_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, slip: int = SLIP, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts."""
    vocabulary = cut(words(docs, min_chars, min_count, slip), "spelling-words")
    near = near_words(vocabulary, block)
    better = F.col("best_n") >= times * F.col("n")
    rows = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    rows = cut(rows, "spelling-forms")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
