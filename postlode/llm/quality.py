"""Text quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text falls into a bin, and every bin has a learned value; pairs of features have small tables of their
own.  The tables are grown by cyclic boosting: round after round, each feature in turn gets a tree of at most three
leaves (each pair a tree of one cut per side), fitted to the gradient of the log loss and added with a small step.  A
score is the logistic function of a sum of looked-up values.

The model is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows, taken in the order of a hash of the id.
Features come from the text only.

Defined cases: a missing text is an empty one and is scored like any other; labels that are missing or name no document
are not used, and several labels of one document count as their mean, rounded; without labels of both classes the score
is their share (0.5 without any).  Rows repeated in full are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text

TRAIN_ROWS = 20_000
HELD_OUT = 2
FOLDS = 4
KEEP_AT = 0.7

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "marks", "symbols", "spaces", "distinct_words",
    "top_word", "bare_words", "doubled_marks", "repeated_lines", "echoes", "short_words",
)
_KIND = np.full(256, 6)  # bytes of letters beyond ASCII
_KIND[:128] = 5          # symbols and controls
_KIND[list(b" \t\n\r\x0b\x0c")] = 0
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[list(b".,;:!?'\"()-")] = 4


def features(text: str) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    size = max(raw.size, 1)
    kinds = _KIND[raw]
    space, upper, lower, digit, mark, symbol, beyond = np.bincount(kinds, minlength=7) / size
    odd = (kinds >= 3) & (kinds <= 5)
    doubled = np.count_nonzero(odd[1:] & odd[:-1] & (raw[1:] == raw[:-1])) / size
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    echoes = sum(map(str.__eq__, words, words[1:])) / n
    bare = sum(c for x, c in counts.items() if not any(map(str.isalnum, x)))
    return [
        np.log1p(raw.size), np.log1p(len(words)), sum(map(len, words)) / n, upper + lower + beyond, upper / max(upper + lower, 1e-9), digit, mark,
        symbol, space, len(counts) / n, max(counts.values(), default=0) / n, bare / n, doubled,
        1 - len(set(lines)) / len(lines) if lines else 0.0, echoes, sum(c for x, c in counts.items() if len(x) <= 2) / n,
    ]


@dataclass
class Additive:
    """Lookup tables of single features and of pairs; ``score`` adds the values of a row's bins."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[bins[:, i] // self.coarse, bins[:, j] // self.coarse]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.margin(self.bins(x)) if self.edges else np.full(len(x), self.intercept)
        return 1 / (1 + np.exp(-margin))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to part a run of bins in two, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of at most three leaves over one feature's bins."""
    gain, first = _cut(g, h)
    if gain <= 0:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    (left, a), (right, b) = _cut(g[:first], h[:first]), _cut(g[first:], h[first:])
    at = [0, first, len(g)]
    if max(left, right) > 0:
        at = sorted([*at, a if left >= right else first + b])
    return np.concatenate([np.full(v - u, _leaf(g[u:v].sum(), h[u:v].sum())) for u, v in zip(at, at[1:]) if v > u])


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Values of the best tree with one cut on each side of a pair's table, and what it gains over no cut."""
    if min(g.shape) < 2:
        return 0.0, np.full_like(g, _leaf(g.sum(), h.sum()))

    def quarters(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        corner, rows, cols = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [corner, rows - corner, cols - corner, c[-1, -1] - rows - cols + corner]

    gain = sum(u**2 / (v + 1) for u, v in zip(quarters(g), quarters(h)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, step: float = 0.15, n_bins: int = 32, n_pairs: int = 6) -> Additive:
    """Grow the tables from features and 0/1 labels."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Additive(float(np.log(share / (1 - share))))
    model = Additive(float(np.log(share / (1 - share))))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, size in enumerate(sizes):
            g, h = slopes()
            values = step * _tree(np.bincount(bins[:, j], g, size), np.bincount(bins[:, j], h, size))
            model.tables[j] += values
            margin += values[bins[:, j]]

    coarse = bins // model.coarse
    widths = [(s - 1) // model.coarse + 1 for s in sizes]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        cell, shape = coarse[:, i] * widths[j] + coarse[:, j], (widths[i], widths[j])
        return _grid(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))

    every = [(i, j) for i in range(len(sizes)) for j in range(i)]
    model.pairs = sorted(every, key=lambda p: (-grid(*p)[0], p))[:n_pairs]
    model.pair_tables = [np.zeros((widths[i], widths[j])) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            values = step * grid(i, j)[1]
            table += values
            margin += values[coarse[:, i], coarse[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def features_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return run(text)


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Additive:
    """Fit on labelled documents outside the held-out fold: at most ``train_rows``, in the order of a hash of their ids."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # The ids chosen are bounded by train_rows, so they go to every task.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", features_of(F.col("text")).alias("x"))
    rows = sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows], dtype=float))


def quality_score(text: Column, model: Additive) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return run(text)


def score_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = docs.select("doc_id", quality_score(whole_text(), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
