"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word from the two words on each side: their embeddings, scaled by position, are summed and
squashed, and give the probability of the word's class and of the word within it.  The summed conditional log
probabilities of all words of a document are its score.

Words are counted over the whole corpus; the ``WORDS`` most frequent have an id of their own, all others one of
``HASHED`` ids by a hash.  The network gives the probability of such an id, and the corpus that of the word among all that
share it: (count + 1) / (counts of the id + its distinct words + 1), with count 0 for a word never seen.  The counts stay in
a table, which grows with the corpus and meets each document's own words in a join; a word without an id of its own is
rarer than ``WORDS`` others, so no key of that join is hot.  The shares of the ``SHARES`` most frequent of these words go to
every task instead, which only spares rows of the join.  Training predicts every position of every text once: the positions are dealt
over the rounds.  A word is never among its own inputs, so nothing needs to be masked.  In each round every task starts
from the same weights, trains on the round's positions of its part of the corpus, and the weights of all tasks are
averaged by the number of positions behind them; the sums are made by Spark, and only their result, of fixed size,
reaches the driver.

Texts are split and counted on Arrow arrays, where a word is looked up once in ``AT_ONCE`` texts.  The products of a step take
its positions in the order of their words' classes, so that each class reads and writes one slice.

Defined cases: a missing text is an empty one; a text without words has 0 words, log probability 0 and no mean.  Rows
repeated in full score alike.  Scores depend on how the input is split, and agree between runs over the same splits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from postlode.session import cut

from .common import whole_text

CLASSES = 64
SIZE = CLASSES * CLASSES
HASHED = 512
WORDS = SIZE - HASHED
SIDE = 2
DIM = 24
ROUNDS = 2
BATCH = 2048
CHUNK = 4096
AT_ONCE = 1000
SCORED = 1 << 14
SHARES = 1 << 16
STEEP = 80.0  # the exponential of less, and the sum of one for each class, fits into 32 bits
FIXED = 1 << 30


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and the words of all texts one after another, as ``words_of`` gives them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, edges = parts.flatten(), parts.offsets.to_numpy()
    # White space at the ends of a text leaves empty parts.
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return np.diff(before[edges - edges[0]]), words.filter(pa.array(real)).cast(pa.binary())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(k, AT_ONCE)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word of the whole corpus, as a stored table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = split_words(batch.column("text"))[1].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

    counts = docs.select(whole_text().alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(counts, "lm-words")


def vocabulary(counts: DataFrame, size: int = WORDS) -> dict[bytes, int]:
    """Ids of the most frequent words; at most ``size`` words reach the driver."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(size).collect()
    return {bytes(r["word"]): i for i, r in enumerate(top)}


def _bucket() -> Column:
    return F.crc32("word") % HASHED


def hashed_words(counts: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``word, n`` of the words that share a hashed id."""
    own = counts.sparkSession.createDataFrame([(bytearray(w),) for w in known], "word binary")
    return counts.join(F.broadcast(own), "word", "left_anti")


def log_shares(words: DataFrame, hashed: DataFrame) -> DataFrame:
    """``words`` (with a column ``word``) and ``log_share``, the log probability of the word among those of its hashed id."""
    # One row per hashed id, so its size is fixed.
    ids = hashed.groupBy(_bucket().alias("_id")).agg(F.sum("n").alias("_total"), F.count("*").alias("_words"))
    found = words.withColumn("_id", _bucket()).join(hashed.withColumnRenamed("n", "_n"), "word", "left").join(F.broadcast(ids), "_id", "left")
    nought = lambda name: F.coalesce(name, F.lit(0))
    share = F.log((nought("_n") + 1) / (nought("_total") + nought("_words") + 1))
    return found.withColumn("log_share", share).drop("_id", "_n", "_total", "_words")


def frequent_shares(hashed: DataFrame, size: int = SHARES) -> dict[bytes, float]:
    """``log_share`` of the most frequent words of ``hashed``; at most ``size`` words reach the driver."""
    top = hashed.orderBy(F.col("n").desc(), "word").limit(size).select("word")
    return {bytes(r["word"]): r["log_share"] for r in log_shares(top, hashed).collect()}


def ids_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    get = known.get
    return np.array([i if (i := get(w)) is not None else WORDS + zlib.crc32(w) % HASHED for w in words], dtype=np.int64)


class Network:
    """Weights by name; ``SIZE`` is the id of the edge of a text."""

    shapes = {"embed": (SIZE + 1, DIM), "place": (2 * SIDE, DIM), "shift": (DIM,), "class_w": (DIM, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, DIM, CLASSES), "word_b": (CLASSES, CLASSES)}

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.w = {k: (rng.normal(0, 0.1, s) if k[-2:] != "_b" and k != "shift" else np.zeros(s)).astype(np.float32) for k, s in self.shapes.items()}
        self.w["place"] += 1

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.shapes])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.w[k] = values[at:at + n].reshape(s).astype(np.float32)
            at += n
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = np.einsum("npd,pd->nd", self.w["embed"].take(around, axis=0), self.w["place"])
        z += self.w["shift"]
        return np.tanh(z, out=z)

    @staticmethod
    def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every row, weights in proportion to its softmax, in the place of ``z``, and their sum."""
        if max(z.max(), -z.min()) > STEEP:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], z.dtype)

    def _outputs(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of positions in the order of their classes: ``h`` with a 1 beside it, the class's and the word's unscaled probabilities.

        Each class reads and writes one slice; the slices are ``parts``, and ``word_w`` has the row of ``word_b`` beneath it.
        """
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        of_class = h @ np.concatenate([self.w["class_w"], self.w["class_b"][None]])
        word_w = np.concatenate([self.w["word_w"], self.w["word_b"][:, None]], axis=1)
        counts = np.bincount(kind, minlength=CLASSES)
        ends = np.cumsum(counts)
        parts = [(c, slice(int(ends[c] - counts[c]), int(ends[c]))) for c in np.flatnonzero(counts).tolist()]
        of_word = np.empty((len(h), CLASSES), h.dtype)
        for c, part in parts:
            np.matmul(h[part], word_w[c], out=of_word[part])
        return h, parts, *self._exp(of_class), *self._exp(of_word)

    def log_prob(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log probability of each word, given the words around it."""
        if not len(word):
            return np.zeros(0, dtype=np.float32)
        order = np.argsort((word // CLASSES).astype(np.int16), kind="stable")
        kind, place, rows = word[order] // CLASSES, word[order] % CLASSES, np.arange(len(word))
        _, _, p, p_sum, q, q_sum = self._outputs(self.hidden(around[order]), kind)
        out = np.empty(len(word), p.dtype)
        out[order] = np.log(np.maximum(p[rows, kind] / p_sum, 1e-30)) + np.log(np.maximum(q[rows, place] / q_sum, 1e-30))
        return out

    def gradient(self, around: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log probability; that of ``embed`` is summed by id, one row for each of ``ids``."""
        order, n = np.argsort((word // CLASSES).astype(np.int16), kind="stable"), np.float32(len(word))
        around, kind, place, rows = around[order], word[order] // CLASSES, word[order] % CLASSES, np.arange(len(word))
        h = self.hidden(around)
        one_h, parts, p, p_sum, q, q_sum = self._outputs(h, kind)
        p *= (1 / p_sum)[:, None]
        p[rows, kind] -= 1
        q *= (1 / q_sum)[:, None]
        q[rows, place] -= 1
        of_word, dh = np.zeros((CLASSES, DIM + 1, CLASSES), h.dtype), np.empty_like(h)
        for c, part in parts:
            np.matmul(one_h[part].T, q[part], out=of_word[c])
            np.matmul(q[part], self.w["word_w"][c].T, out=dh[part])
        dh += p @ self.w["class_w"].T
        dz = dh * (1 - h * h) / n
        of_class = one_h.T @ p / n
        of_word /= n
        g = {"class_w": of_class[:DIM], "class_b": of_class[DIM], "word_w": of_word[:, :DIM], "word_b": of_word[:, DIM], "shift": dz.sum(0)}
        g["place"] = np.einsum("npd,nd->pd", self.w["embed"].take(around, axis=0), dz)
        each, at = np.ascontiguousarray(dz.T)[:, :, None] * np.ascontiguousarray(self.w["place"].T)[:, None], around.ravel()
        g["ids"] = np.flatnonzero(np.bincount(at))
        g["embed"] = np.stack([np.bincount(at, x.ravel())[g["ids"]] for x in each], axis=1).astype(h.dtype)
        return g


class Trainer:
    """Adagrad, which keeps rare words moving."""

    def __init__(self, net: Network, rate: float = 0.1) -> None:
        self.net, self.rate = net, rate
        self.sums = {k: np.full_like(v, 1e-4) for k, v in net.w.items()}

    def step(self, around: np.ndarray, word: np.ndarray) -> None:
        grad = self.net.gradient(around, word)
        rows = grad.pop("ids")
        for k, g in grad.items():
            at = rows if k == "embed" else ...
            sums = self.sums[k][at]
            sums += g * g
            if k == "embed":
                self.sums[k][rows] = sums
            change = np.sqrt(sums)
            np.divide(g, change, out=change)
            change *= self.rate
            self.net.w[k][at] -= change


def chunk_ids(texts: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, and for all texts one after another the ids, the words' numbers, and the words by number."""
    sizes, words = split_words(texts)
    words = words.dictionary_encode()
    distinct, number = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
    return sizes, ids_of(distinct, known)[number], number, distinct


def all_contexts(sizes: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``contexts`` and ids of the wanted positions of texts of these sizes, whose ids stand one after another."""
    at = np.arange(len(ids)) + SIDE + 2 * SIDE * np.repeat(np.arange(len(sizes)), sizes)
    padded = np.full(len(ids) + 2 * SIDE * len(sizes), SIZE)
    padded[at] = ids
    at = at[wanted]
    return padded[at[:, None] + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])], padded[at]


def places(sizes: np.ndarray) -> np.ndarray:
    """The place in its text of every word of texts of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of the words on both sides of each position."""
    padded = np.concatenate([np.full(SIDE, SIZE), ids, np.full(SIDE, SIZE)])
    return padded[at[:, None] + np.array([*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)])]


def first_target(text: str, turn: int, rounds: int) -> int:
    return (zlib.crc32(text[:64].encode("utf-8", "surrogatepass")) + turn) % rounds


def targets(text: str, n: int, turn: int, rounds: int) -> np.ndarray:
    """The positions of a text of ``n`` words that round ``turn`` predicts; over all rounds, each position once.

    Texts begin at different places, so that a round doesn't see all first words or none.
    """
    return np.arange(first_target(text, turn, rounds), n, rounds)


def examples(batches: Iterator[pa.RecordBatch], known: dict[bytes, int], turn: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``contexts`` and ids of the round's ``targets``: of texts until they have ``BATCH``, ``BATCH`` at a time and then the rest."""
    around, word = np.zeros((0, 2 * SIDE), dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in slices(batches):
        texts = batch.column("text")
        sizes, ids, _, _ = chunk_ids(texts, known)
        first = np.array([first_target(text, turn, rounds) for text in pc.utf8_slice_codeunits(texts, 0, 64).to_pylist()])
        found = all_contexts(sizes, ids, places(sizes) % rounds == np.repeat(first, sizes))
        start, ends = 0, len(word) + np.cumsum(np.maximum(-(-(sizes - first) // rounds), 0))
        around, word = np.concatenate([around, found[0]]), np.concatenate([word, found[1]])
        for end in ends.tolist():
            if end - start >= BATCH:
                for k in range(start, end, BATCH):
                    yield around[k:min(k + BATCH, end)], word[k:min(k + BATCH, end)]
                start = end
        around, word = around[start:], word[start:]
    if len(word):
        yield around, word


def train_round(docs: DataFrame, known: dict[bytes, int], start: np.ndarray, turn: int = 0, rounds: int = 1) -> np.ndarray:
    """One pass of every task over the round's positions of its texts, and the mean of their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network().load(start), 0
        trainer = Trainer(net)
        for around, word in examples(batches, known, turn, rounds):
            trainer.step(around, word)
            seen += len(word)
        if seen:
            values = net.flat()
            parts = [values[k:k + CHUNK] for k in range(0, len(values), CHUNK)]
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "weight", "values"])

    parts = docs.select(whole_text().alias("text")).mapInArrow(run, "part int, weight double, values array<float>")
    every = parts.select("part", "weight", F.posexplode_outer("values").alias("pos", "v"))
    mean = every.groupBy("part", "pos").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    out = start.copy()
    for r in mean.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("vs")).select("part", "vs.v").toLocalIterator():
        out[r["part"] * CHUNK:r["part"] * CHUNK + len(r["v"])] = r["v"]
    return out


def fit_masked_lm(docs: DataFrame, rounds: int = ROUNDS) -> tuple[dict[bytes, int], np.ndarray, DataFrame]:
    """Ids of the frequent words, the weights, and the table of counts of all other words."""
    counts = word_counts(docs)
    known = vocabulary(counts)
    weights = Network().flat()
    for turn in range(rounds):
        weights = train_round(docs, known, weights, turn, rounds)
    return known, weights, hashed_words(counts, known)


def sums_by_text(sizes: np.ndarray, ids: np.ndarray, net: Network, at_once: int) -> np.ndarray:
    """Summed log probability of the ids of each text, every word predicted from both sides, ``at_once`` positions at a time."""
    around, word = all_contexts(sizes, ids, np.ones(len(ids), dtype=bool))
    each = [net.log_prob(around[k:k + at_once], word[k:k + at_once]) for k in range(0, len(word), at_once)]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*each, np.zeros(0)]), minlength=len(sizes)).astype(float)


def document_scores(texts: list[str], known: dict[bytes, int], net: Network, at_once: int = SCORED) -> list[tuple[int, float]]:
    """(number of words, summed log probability of their ids) of each text."""
    sizes, ids, _, _ = chunk_ids(pa.array(texts, pa.string()), known)
    return list(zip(sizes.tolist(), sums_by_text(sizes, ids, net, at_once).tolist()))


def score_documents(docs: DataFrame, model: tuple[dict[bytes, int], np.ndarray, DataFrame], at_once: int = SCORED) -> DataFrame:
    """doc_id, n_words, log_prob and mean_log_prob of every row of ``docs``."""
    known, weights, hashed = model
    # Both go to every task once; their sizes are bounded by WORDS and SHARES.
    tables = docs.sparkSession.sparkContext.broadcast((weights, frequent_shares(hashed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shares = tables.value
        net = Network().load(weights)
        for batch in slices(batches):
            sizes, ids, number, distinct = chunk_ids(batch.column("text"), known)
            scores = sums_by_text(sizes, ids, net, at_once)
            # Each text's own words that have no id of their own, and how often it has them.
            pairs = (np.repeat(np.arange(len(sizes)), sizes) * len(distinct) + number)[ids >= WORDS]
            pairs, times = np.unique(pairs, return_counts=True)
            owner, number = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
            share = np.array([shares.get(w, np.nan) for w in distinct])[number]
            told = ~np.isnan(share)
            fixed = np.zeros(len(sizes), dtype=np.int64)
            np.add.at(fixed, owner[told], np.round(times[told] * share[told] * FIXED).astype(np.int64))
            owner, number, times = owner[~told], number[~told], times[~told]
            edges = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
            words = pa.array(distinct, pa.binary()).take(pa.array(number))
            columns = {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "id_log_prob": pa.array(scores),
                "told": pa.array(fixed), "words": pa.ListArray.from_arrays(edges, words), "times": pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = cut(rows.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, id_log_prob double, told bigint, words array<binary>, times array<bigint>"), "lm-rows")
    others = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times").withColumnRenamed("words", "word")
    # Summed as whole numbers, the result doesn't depend on the order of the rows.
    share = F.round(F.col("times") * F.col("log_share") * FIXED).cast("long")
    shares = log_shares(others, hashed).groupBy("row").agg(F.sum(share).alias("share"))
    rows = rows.select("row", "doc_id", "n_words", "id_log_prob", "told").join(shares, "row", "left")
    rows = rows.select("doc_id", "n_words", (F.col("id_log_prob") + (F.col("told") + F.coalesce("share", F.lit(0))) / FIXED).alias("log_prob"))
    return rows.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
