"""License scans by diagonal voting.

Every rolling three-word hash of a text is joined to the positions where a template has it.  A hit at word ``w`` of the
text and position ``t`` of the template votes for the diagonal ``w - t``; a whole phrase is a diagonal with a vote for each
of its positions.  Neighbouring diagonals of one template are merged, since an added or a missing word shifts the rest of
a notice by one, and a merged run counts if its verified words cover enough of the template.  Every hit is verified word
by word as it is joined, so a vote is never a mere hash collision.

Base phrases must stand in full (``n_base`` places, labels below); notices add labels of their own from ``COVERAGE`` on.

Defined cases: a missing text is an empty one; a text of fewer than three words has no hit, no label and score 0; rows
repeated in full get the same result each.  ``lower`` is used instead of lower-casing A to Z alone: the only other
characters that it maps to ASCII letters are the Kelvin sign (k) and the dotted capital I (i and a combining dot, which
stays part of the word), and no phrase has a k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import row_key, whole_text

GRAM = 3
COVERAGE = 0.8  # share of a notice's words
SHIFT = 4       # diagonals of one notice that lie this close belong together
MARK = -1       # stands behind the hashes of each document, so that documents without a hit stay
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licenses.
NOTICES = {
    "agpl": "gnu affero general public license",
    "gpl": "gnu general public license",
    "lgpl": "gnu lesser general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "creative commons attribution 4 0 international license",
    "cc-by-sa": "creative commons attribution sharealike",
    "cc-by-sa ": "cc by sa",
    "cc0": "cc0 1 0 universal",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2": "mozilla public license version 2 0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "public-domain": "this is free and unencumbered software released into the public domain",
}


def grams(words: list[str]) -> list[list[str]]:
    return [words[i:i + GRAM] for i in range(len(words) - GRAM + 1)]


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per position of a template: its words and their hash.  The size is that of the templates.

    A last row matches the mark that stands behind the hashes of every document.
    """
    rows = [
        (base, label.strip(), text, i, len(text.split()), " ".join([*gram, ""]), *gram)
        for base, table in ((True, {v + "\0" + k: k for k, v in phrases.items()}), (False, notices))
        for label, text in ((k.split("\0")[0], v) for k, v in table.items())
        for i, gram in enumerate(grams(text.split()))
    ]
    rows.append((None, None, None, -1, 0, "", "", "", ""))
    table = spark.createDataFrame(rows, "base boolean, label string, template string, t int, size int, gram string, t0 string, t1 string, t2 string")
    return table.withColumn("hash", F.when(F.col("t") < 0, F.lit(MARK)).otherwise(F.xxhash64("t0", "t1", "t2"))).drop("t0", "t1", "t2")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def hits(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """The verified votes of all texts, one row per hit of a template position, and one row per document without a template."""
    text = whole_text()
    rows = docs.select(*row_key(F.col("doc_id"), text), "doc_id", words_of(text).alias("words"))
    word = F.col("words")
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.size(word) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(word) - GRAM), lambda i: F.xxhash64(*[F.get(word, i + j) for j in range(GRAM)]))).otherwise(none)
    # The hashes are a column of their own: unrolled straight from an expression, each would carry a copy of all words.
    # The outer form is used as the inner one makes the optimizer filter by the array's size, computing it once more.
    rows = rows.withColumn("hashes", F.concat(hashes, F.array(F.lit(MARK).cast("bigint"))))
    every = rows.select("k1", "k2", "doc_id", "words", F.posexplode_outer("hashes").alias("w", "hash"))
    # Hash first, then the words; "starts with" up to a final blank is equality that stays out of the join's key.
    gram = F.concat_ws(" ", F.slice(word, F.col("w") + 1, GRAM), F.lit(""))
    last = F.col("w") == F.greatest(F.size(word) - GRAM + 1, F.lit(0))
    same = (F.col("hash") == F.col("t_hash")) & F.startswith(gram, F.col("gram")) & ((F.col("t") >= 0) | last)
    # The template table is bounded by the templates above.
    found = every.join(F.broadcast(templates(docs.sparkSession, phrases, notices).withColumnRenamed("hash", "t_hash")), same)
    return found.select(
        "k1", "k2", "doc_id", F.size(word).cast("long").alias("n_words"), "base", "label", "template", "size", "t",
        F.when(F.col("t") >= 0, F.col("w") - F.col("t")).alias("diagonal"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row of ``docs``: word count, base places and labels, all labels, and the best coverage of a template as score."""
    document = ["k1", "k2", "doc_id", "n_words"]
    votes = hits(docs, phrases, notices).groupBy(*document, "base", "label", "template", "size", "diagonal").agg(F.collect_set("t").alias("ts"), F.count("*").alias("copies"))
    near = Window.partitionBy(*document, "base", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SHIFT, F.lit(True))
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(near))
    spans = runs.groupBy(*document, "base", "label", "template", "size", "run").agg(
        F.min("diagonal").alias("first"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.max("copies").alias("copies"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + GRAM - 1)))))
    spans = spans.withColumn("covered", F.when(F.col("size") > 0, covered / F.col("size")).otherwise(F.lit(0.0)))
    is_base = F.col("base") & (F.col("covered") == 1)
    labelled = is_base | (~F.col("base") & (F.col("covered") >= COVERAGE))
    out = spans.groupBy(*document).agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(labelled, F.col("label")))), ",").alias("labels"),
        F.max("covered").alias("score"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).cast("int").alias("copies"),
    )
    out = out.withColumn("_copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
