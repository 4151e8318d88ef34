"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

A text is split by the tokenizer's pattern; each piece is encoded on its own.  The encoding of a word is a fold over its
bytes with Spark's higher-order functions: the adjacent pair of lowest rank is merged, the leftmost of equals first, until
no pair has a rank.  A merged token's id is its rank, so the fold works on arrays of ids, and a rank map of pairs answers
which id two neighbours merge into.  That map, of fixed size, is a literal of the plan: a session variable.

The words of a corpus repeat, so each distinct word is folded once as long as a dictionary of bounded size has room for
it: at most ``DICTIONARY`` words, the most frequent by a count over the whole corpus, none longer than ``WORD_BYTES``.
The dictionary decides only where a word's fold runs.  All other words occur too rarely for a fold by lambdas to pay
(about 170 us a word): they are folded by a small Python helper with the same ranks, each once in a run of ``ROWS`` texts, or in
a task as long as it holds the word.  A task keeps all ids it holds in one array, so that a run's ids are copied at once.
The ids are set in the places of the words on Arrow arrays, so no text is ever a list of Python strings.  No text is shuffled.

Defined cases: a missing text is an empty one and has no ids; rows repeated in full are encoded alike; a long unbroken
piece is folded like any other, at a cost of its length times its logarithm.
"""

from __future__ import annotations

import base64
import functools
import heapq
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postlode.session import cut

from .common import whole_text

DICTIONARY = 1 << 16
WORD_BYTES = 48
PAIR_BUCKETS = 1 << 18
NONE = (1 << 31) - 1  # ranks of pairs that don't merge
WIDTH = 1 << 17       # a pair of ids is kept as left * WIDTH + right
ROWS = 512            # texts whose words are looked up at a time
HELD = 1 << 18        # words that a task holds with their ids, at most 16 ids each on average

# Unicode white space; Java's \s knows ASCII only.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with white space spelled out, inside and outside of classes."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class Ranks:
    """A rank file, read on the driver; its size is that of the vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}

    def merges(self) -> list[tuple[int, int]]:
        """(pair, id): every way to make a token of two others."""
        ids = self.ids
        return [(ids[t[:i]] * WIDTH + ids[t[i:]], r) for t, r in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]

    def by_id(self) -> list[bytes]:
        out = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            out[i] = token
        return out


def fold_bytes(word: bytes, ids: dict[bytes, int]) -> list[int]:
    """Ids of one word.  Candidate merges wait in a heap by rank and place; one whose neighbours changed is skipped."""
    n = len(word)
    end = list(range(1, n + 1))  # of the token that begins here, 0 inside of tokens
    begin = list(range(-1, n))   # of the token that ends here
    waiting = [(ids[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ids]
    heapq.heapify(waiting)
    while waiting:
        _, at, stop = heapq.heappop(waiting)
        middle = end[at]
        if middle in (0, n) or end[middle] != stop:
            continue
        end[at], end[middle], begin[stop] = stop, 0, at
        for left, right in ((at, end[stop] if stop < n else 0), (begin[at], stop)):
            if left >= 0 and right and (rank := ids.get(word[left:right])) is not None:
                heapq.heappush(waiting, (rank, left, right))
    out, at = [], 0
    while at < n:
        out.append(ids[word[at:end[at]]])
        at = end[at]
    return out


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return first(F.transform(F.array(value), body))


def literal(value: DataFrame) -> Column:
    """The single value of a DataFrame as a constant of later plans; lambdas may mention it, unlike a subquery."""
    name, view = (f"{kind}_{uuid.uuid4().hex}" for kind in ("value", "rows"))
    spark, field = value.sparkSession, value.schema[0]
    value.createTempView(view)
    spark.sql(f"DECLARE VARIABLE {name} {field.dataType.simpleString()}")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {view})")
    spark.catalog.dropTempView(view)
    return F.expr(f"session.{name}")


def buckets(rows: DataFrame, bucket: Column, n: int, key: str, value: str) -> Column:
    """A table as one value: an array of ``n`` small maps.  ``rows`` must be of bounded size."""
    found = rows.groupBy(bucket.cast("int").alias("b")).agg(F.collect_list(F.struct(key, value)).alias("e"))
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("b"))
    filled = every.join(found, "b", "left").select("b", F.coalesce("e", F.array().cast(found.schema["e"].dataType)).alias("e"))
    return literal(filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "e"))), lambda x: F.map_from_entries(x["e"])).alias("maps")))


class Held:
    """The ids of words that a task has met, one after another in one array; a word has a place in it."""

    def __init__(self, words: dict[str, bytes], ranks: dict[bytes, int]) -> None:
        self.words, self.ranks = words, ranks
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 16, dtype=np.int32), array("q", [0]), 0

    def numbers_of(self, words: list[str]) -> np.ndarray:
        """The numbers of the words; those that are not held are folded first, or taken from the dictionary."""
        if len(self.number) + len(words) > HELD or self.used > HELD * 16:
            self.clear()
        get, found, new = self.number.get, [], []
        for word in words:
            n = get(word)
            if n is None:
                n = self.number[word] = len(self.number)
                ids = self.words.get(word)
                new.append(ids if ids is not None else array("i", fold_bytes(word.encode("utf-8"), self.ranks)).tobytes())
                self.ends.append(self.ends[-1] + len(new[-1]) // 4)
            found.append(n)
        more = np.frombuffer(b"".join(new), dtype=np.int32)
        if self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(more), dtype=np.int32)])
        self.ids[self.used:self.used + len(more)] = more
        self.used += len(more)
        return np.array(found, dtype=np.int64)


def numbers(pieces: pa.ListArray, held: Held) -> pa.ListArray:
    """The ids of each list of words: every distinct word is looked up once, its ids are copied to all its places."""
    flat = pieces.flatten().dictionary_encode()
    word = held.numbers_of(flat.dictionary.to_numpy(zero_copy_only=False).tolist())[flat.indices.to_numpy(zero_copy_only=False)]
    # A copy, as an array whose memory is lent can't grow.
    edges = np.array(held.ends, dtype=np.int64)
    starts, sizes = edges[word], edges[word + 1] - edges[word]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = held.ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    edges = pieces.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends[edges - edges[0]], pa.int32()), pa.array(ids, pa.int32()))


class Tokenizer:
    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str) -> None:
        ranks = Ranks(ranks_path)
        self.ranks = ranks.ids
        self.pattern = java_pattern(pattern)
        pairs = spark.createDataFrame(ranks.merges(), "pair bigint, id int")
        self.pairs = buckets(pairs, self.pair_bucket(F.col("pair")), PAIR_BUCKETS, "pair", "id")
        tokens = ranks.by_id()
        row = {"bytes": [ranks.ids[bytes([b])] for b in range(256)], "tokens": [t.hex() for t in tokens], "words": [i.to_bytes(4, "little").hex() for i in range(len(tokens))]}
        fixed = spark.createDataFrame([row], "bytes array<int>, tokens array<string>, words array<string>")
        self.byte_ids, self.token_hex, self.id_hex = (literal(fixed.select(c)) for c in ("bytes", "tokens", "words"))

    @staticmethod
    def pair_bucket(pair: Column) -> Column:
        return F.pmod(pair * 40503, F.lit(PAIR_BUCKETS))

    def merged(self, left: Column, right: Column) -> Column:
        """Id of the token that two neighbours make, or NONE."""
        pair = left.cast("bigint") * WIDTH + right
        return bound(pair, lambda p: F.coalesce(F.get(self.pairs, self.pair_bucket(p).cast("int"))[p], F.lit(NONE)))

    def fold(self, word: Column) -> Column:
        """Ids of one word: the ranked merges folded over its bytes."""
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        start = F.transform(chars, lambda c: F.get(self.byte_ids, F.ascii(c)))

        def ranks(ids: Column) -> Column:
            return F.when(F.size(ids) > 1, F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: self.merged(F.get(ids, i), F.get(ids, i + 1)))).otherwise(F.array().cast("array<int>"))

        def merge(s: Column, p: Column, low: Column) -> Column:
            """Put ``low`` in the place of the tokens at ``p`` and ``p + 1``, counted from 1."""
            ids, old, n = s["ids"], s["ranks"], F.size(s["ids"])
            none = F.array().cast("array<int>")
            before = F.when(p > 1, F.array(self.merged(F.get(ids, p - 2), low))).otherwise(none)
            after = F.when(p + 1 < n, F.array(self.merged(low, F.get(ids, p + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(low), F.slice(ids, p + 2, n)).alias("ids"),
                F.concat(F.slice(old, F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(old, p + 2, n)).alias("ranks"),
            )

        def step(s: Column, _: Column) -> Column:
            return bound(F.array_min(s["ranks"]), lambda low: F.when(low == NONE, s).otherwise(
                bound(F.array_position(s["ranks"], low).cast("int"), lambda p: merge(s, p, low))))

        def run(ids: Column) -> Column:
            state = F.struct(ids.alias("ids"), ranks(ids).alias("ranks"))
            return F.aggregate(F.sequence(F.lit(2), F.size(ids)), state, step, lambda s: s["ids"])

        return bound(start, lambda ids: F.when(F.size(ids) < 2, ids).otherwise(run(ids)))

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def words(self, docs: DataFrame) -> DataFrame:
        """Every distinct piece of the corpus that is short enough for a dictionary, with its count."""
        # The outer form, as the inner one makes the optimizer split the text twice, once for a filter by the array's size.
        piece = docs.select(F.explode_outer(self.pieces(whole_text())).alias("word"))
        return piece.where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count("*").alias("n"))

    def dictionary(self, docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
        """(word, ids) of the most frequent words, at most ``size`` of them.

        The words are taken by classes of their count, the highest first, so that a table of some hundred rows decides.
        """
        level = F.floor(F.log2("n") * 8).cast("int")
        words = cut(self.words(docs), "bpe-words")
        levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("words"))
        over = Window.orderBy(F.col("level").desc())
        lowest = levels.withColumn("sum", F.sum("words").over(over)).where(F.col("sum") <= size).agg(F.coalesce(F.min("level"), F.lit(1 << 20))).scalar()
        return cut(words.where(level >= lowest).select("word").repartition("word").select("word", self.fold(F.col("word")).alias("ids")), "bpe-dictionary")

    def encode(self, docs: DataFrame, ids: str = "ids") -> DataFrame:
        """doc_id and ``ids`` (array<int>) of every row of ``docs``."""
        return docs.select("doc_id", self.fill_in(self.dictionary(docs))(self.pieces(whole_text())).alias(ids))

    def fill_in(self, dictionary: DataFrame):
        """The ids of a list of words.  The dictionary goes to every task; its size is bounded by ``DICTIONARY``."""
        words = {word: np.array(ids, dtype=np.int32).tobytes() for word, ids in dictionary.select("word", "ids").collect()}
        tables = dictionary.sparkSession.sparkContext.broadcast((words, self.ranks))

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held = Held(*tables.value)
            for batch in batches:
                parts = [numbers(batch.slice(i, ROWS), held) for i in range(0, len(batch), ROWS)]
                yield pa.concat_arrays(parts or [pa.array([], pa.list_(pa.int32()))])

        return run

    def decode(self, ids: Column) -> Column:
        """The bytes of a list of ids: binary pieces, set one after another."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.token_hex, i)), ""))

    def packed(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.id_hex, i)), ""))


@functools.lru_cache(maxsize=4)
def tokenizer(spark: SparkSession, ranks_path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a session, made once: its constants are session variables, which stay in the driver's memory."""
    return Tokenizer(spark, ranks_path, pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids again, and report the number and digest of ids and the digest of the bytes."""
    t = tokenizer(docs.sparkSession, ranks_path, pattern)
    ids = F.col("ids")
    return t.encode(docs).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(t.packed(ids), 256).alias("ids_sha256"), F.sha2(t.decode(ids), 256).alias("decoded_sha256"),
    )
