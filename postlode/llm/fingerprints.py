"""Document fingerprints: a bottom-k sketch of the hashes of word shingles.

A sketch holds the ``k`` smallest 64-bit hashes of a text's distinct five-word shingles, ascending.  Sketches of parts
merge into the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.
Everything is built from DataFrame functions.

Defined cases: a missing text is an empty one and has an empty sketch; a text of fewer than five words has one shingle,
its whole word sequence.  Two empty sketches have resemblance and containment 1, an empty and a filled one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import numbered, row_key, whole_text

K = 128
SHINGLE = 5


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SHINGLE, known: str | None = None, same: str | None = None) -> DataFrame:
    """Add the sketch of column ``text`` as ``out``, and the hashes of its shingles as ``out``_hashes.

    Where the first words of a text are those of another, ``known`` names that one's hashes and ``same`` the number of
    words, so that the hashes they share are not computed again.  Each step is a column of its own: an expression that a
    lambda mentions would be computed anew for each element.
    """
    words, n, hashes, start = f"_{out}_words", f"_{out}_n", f"{out}_hashes", f"_{out}_start"
    word = F.col(words)
    df = df.withColumn(words, F.array_remove(F.split(F.lower(F.col(text)), r"\s+"), ""))
    df = df.withColumn(n, F.size(words))
    df = df.withColumn(start, F.least(F.greatest(F.col(same) - size + 1, F.lit(0)), F.greatest(F.col(n) - size, F.lit(0))) if same else F.lit(0))
    rolled = F.transform(F.sequence(F.col(start), F.col(n) - size), lambda i: F.xxhash64(*[F.get(word, i + j) for j in range(size)]))
    if known:
        rolled = F.concat(F.slice(F.col(known), F.lit(1), F.col(start)), rolled)
    short = F.when(F.col(n) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(word)))
    df = df.withColumn(hashes, F.when(F.col(n) >= size, rolled).otherwise(short))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(words, n, start)


def as_text(sketch: Column) -> Column:
    """The hashes in decimal, joined by commas."""
    return F.array_join(sketch.cast("array<string>"), ",")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's ``k`` smallest hashes that both sides hold: an unbiased estimate of intersection / union."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of ``a``'s shingles that ``b`` has too."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    of_a = F.array_intersect(union, a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(of_a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(of_a, b)) / F.size(of_a))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else (k - 1) / (largest kept hash as a share of the hash range)."""
    share = F.get(sketch, F.lit(k - 1)).cast("double") / F.lit(float(1 << 64)) + F.lit(0.5)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def merge_sketches(parts: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group of ``by``: the ``k`` smallest distinct hashes of its parts.

    Every task keeps at most ``k`` hashes of a group before the shuffle, so a group with a third of all rows is no
    burden to the task that finishes it.  Groups whose parts are all empty get an empty sketch.
    """
    keys = parts.select(*by).distinct()
    hashes = parts.select(*by, F.explode(sketch).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    kept = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k)
    merged = kept.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("_merged"))
    same = [keys[c].eqNullSafe(merged[c]) for c in by]
    empty = F.array().cast("array<bigint>")
    return keys.join(merged, same, "left").select(*[keys[c] for c in by], F.coalesce("_merged", empty).alias(sketch))


def fingerprint(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """doc_id, text and the ``sketch`` of each row of ``docs``."""
    return with_sketch(docs.select("doc_id", whole_text().alias("text")), "text", "sketch", k, size).drop("sketch_hashes")


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprint each text and a text whose second half is taken from the next document, and compare them.

    The next document has the next smaller doc_id, and the last one is followed by the first.  Equal ids are ordered by
    a hash of id and text, missing ids come last, and rows repeated in full count as one document, of which each row
    gets the same result.  Neighbours are found on a narrow table of handles; texts are shuffled once by their handle,
    for both joins, and only the needed beginning of a text, with its sketch, travels on to the document before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")
    narrow = rows.select("k1", "k2", "doc_id", F.char_length("text").alias("n")).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("k1").asc(), F.col("k2").asc()]
    placed = numbered(narrow, order, "fingerprint-order").select("k1", "k2", "n", "pos")
    total = placed.agg(F.count("*").alias("total"))
    ahead = placed.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n").alias("pn"), F.col("pos").alias("before"))
    behind = placed.select("k1", "k2", F.pmod(F.col("pos") - 1, F.greatest(total.scalar(), F.lit(1))).alias("before"))
    pairs = behind.join(ahead, "before").drop("before")

    # Both joins read one exchange of the texts, so nothing may come between it and the scan: repeated rows are found behind
    # it, by a look at the row before (a rank would put a filter of its own in front of the exchange).
    again = F.lag(F.lit(True), 1, False).over(Window.partitionBy("k1", "k2").orderBy("k1"))
    nexts = rows.join(pairs, ["k1", "k2"]).withColumn("_again", again).where("not _again")
    nexts = with_sketch(nexts.select("p1", "p2", F.expr("pn div 2").alias("half"), F.col("doc_id").alias("next_doc_id"), "text"), "text", "next_sketch", k, size)
    nexts = nexts.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "next_doc_id", F.col("text").substr(F.lit(1), F.col("half").cast("int")).alias("head"), "next_sketch")
    out = rows.join(nexts, ["k1", "k2"]).withColumn("n_chars", F.char_length("text").cast("long"))
    keep = (F.col("n_chars") - F.expr("n_chars div 2")).cast("int")
    out = out.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), keep), "head"))
    # The words of the kept half but its last, which may be cut, are those of the whole text.
    out = out.withColumn("same", F.greatest(F.size(F.array_remove(F.split(F.lower(F.col("text").substr(F.lit(1), keep)), r"\s+"), "")) - 1, F.lit(0)))
    out = with_sketch(out, "text", "sketch", k, size)
    out = with_sketch(out, "edited", "edited_sketch", k, size, known="sketch_hashes", same="same")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_distinct"), "next_doc_id",
    )
