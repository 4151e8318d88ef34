"""Personal data: fixed rules, and a character tagger that adds to them.

The rules find e-mail addresses, IPv4 addresses, card and phone numbers; what they find always stays.  The tagger is a
bidirectional LSTM over character classes with a CRF on top, trained in numpy from labelled spans: those that the rules
find, in a bounded sample of windows, some of them rewritten (other separators, no plus sign), next to windows with digits
and signs that are no personal data.

Long texts are decoded in overlapping windows.  Windows propose spans, and per text the set of spans that do not
overlap and weigh most is chosen, so a span cut by one window's edge loses to the whole one in the next.  The CRF's
structure says that an address has an at sign and that a number begins with a digit or a plus sign, so a window without
any of these can have no span and need not be decoded.

Defined cases: a missing text is an empty one; rows repeated in full get the same result; without any labelled span in
the corpus the tagger adds nothing.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text

KINDS = ("email", "ip", "card", "phone")
TRAIN_WINDOWS = 2_000
WINDOW = 64
DECODE = 128
STRIDE = 64
SURE = 0.95  # least mean probability of an added span

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@+]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the rules: per kind the leftmost that don't overlap, in the order of kinds, then of starts."""
    if not _ANCHOR.search(text):
        return []
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# Tags: outside, e-mail before / at / after the sign, and begin / inside of the three kinds of number.
O, E1, AT, E2 = range(4)
BEGIN, INSIDE = {"ip": 4, "card": 6, "phone": 8}, {"ip": 5, "card": 7, "phone": 9}
TAGS = 10
NO = -1e4
_AFTER = {O: (O, E1, 4, 6, 8), E1: (E1, AT), AT: (E2,), E2: (E2, O)} | {t: (t + 1 - t % 2, O) for t in range(4, 10)}
_MAY = np.full((TAGS, TAGS), NO)
for _a, _bs in _AFTER.items():
    _MAY[_a, list(_bs)] = 0.0
_START, _END = np.full(TAGS, NO), np.zeros(TAGS)
_START[[O, E1, 4, 6, 8]] = 0.0
_END[[E1, AT]] = NO

SIGNS = "@.-_%+() \n,:;/=\"'#|"
PAD = 4 + len(SIGNS)
CLASSES = PAD + 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.full(128, 3)
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = 0, 1, 2
    for i, c in enumerate(SIGNS):
        table[ord(c)] = 4 + i
    return np.where(codes < 128, table[np.minimum(codes, 127)], 0)


def allowed(x: np.ndarray) -> np.ndarray:
    """Scores 0 or NO of each tag at each character, from its class alone."""
    out = np.zeros((*x.shape, TAGS))
    digit, at, plus = x == 2, x == 4, x == 4 + SIGNS.index("+")
    blank = (x == 4 + SIGNS.index(" ")) | (x == 4 + SIGNS.index("\n")) | (x == PAD)
    out[~at, AT] = NO
    for t in (E1, E2):
        out[blank | at, t] = NO
    for t in (4, 6):
        out[~digit, t] = NO
    out[~(digit | plus), 8] = NO
    for t in (5, 7, 9):
        out[(x == 0) | (x == 1) | (x == PAD), t] = NO
    return out


def tags_of(length: int, spans: list[Span], text: str) -> np.ndarray:
    y = np.zeros(length, dtype=int)
    for kind, a, b in spans:
        if kind == "email":
            at = text.index("@", a)
            y[a:at], y[at], y[at + 1:b] = E1, AT, E2
        elif not y[a:b].any():
            y[a], y[a + 1:b] = BEGIN[kind], INSIDE[kind]
    return y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _sum_exp(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))


class Tagger:
    def __init__(self, hidden: int = 12, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.w["h" + d] = rng.normal(0, 0.3, (hidden, 4 * hidden))
        self.w["out"], self.w["bias"] = rng.normal(0, 0.3, (2 * hidden, TAGS)), np.zeros(TAGS)
        self.w["next"] = np.zeros((TAGS, TAGS))

    def _forward(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, h, c, out, kept = self.hidden, np.zeros((len(x), self.hidden)), np.zeros((len(x), self.hidden)), [], []
        for t in range(x.shape[1]):
            z = self.w["x" + d][x[:, t]] + h @ self.w["h" + d]
            s = _sigmoid(z[:, :3 * n])
            i, f, o, g = s[:, :n], s[:, n:2 * n], s[:, 2 * n:], np.tanh(z[:, 3 * n:])
            was, c = c, f * c + i * g
            tc = np.tanh(c)
            kept.append((h, was, i, f, o, g, tc))
            h = o * tc
            out.append(h)
        return np.stack(out, axis=1), kept

    def _backward(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> None:
        n = self.hidden
        dh, dc = np.zeros((len(x), n)), np.zeros((len(x), n))
        for t in range(x.shape[1] - 1, -1, -1):
            h, was, i, f, o, g, tc = kept[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            np.add.at(grad["x" + d], x[:, t], dz)
            grad["h" + d] += h.T @ dz
            dh, dc = dz @ self.w["h" + d].T, dc * f

    def states(self, x: np.ndarray) -> tuple:
        forward, kf = self._forward(x, "f")
        backward, kb = self._forward(x[:, ::-1], "b")
        both = np.concatenate([forward, backward[:, ::-1]], axis=2)
        return both, both @ self.w["out"] + self.w["bias"] + allowed(x), kf, kb

    def _alphas(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        steps = self.w["next"] + _MAY
        a, b = np.empty_like(e), np.empty_like(e)
        a[:, 0] = e[:, 0] + _START
        for t in range(1, e.shape[1]):
            a[:, t] = e[:, t] + _sum_exp(a[:, t - 1, :, None] + steps, 1)
        b[:, -1] = _END
        for t in range(e.shape[1] - 2, -1, -1):
            b[:, t] = _sum_exp(steps + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        return a, b, _sum_exp(a[:, -1] + _END, 1), steps

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood per window of the tags ``y``, and its gradient."""
        both, e, kf, kb = self.states(x)
        a, b, z, steps = self._alphas(e)
        rows, n = np.arange(len(x))[:, None], len(x)
        marginal = np.exp(a + b - z[:, None, None])
        gold = np.zeros_like(e)
        gold[rows, np.arange(x.shape[1])[None], y] = 1
        score = (e * gold).sum() + steps[y[:, :-1], y[:, 1:]].sum()
        de = (marginal - gold) / n
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, x.shape[1]):
            grad["next"] += np.exp(a[:, t - 1, :, None] + steps + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0) / n
        np.add.at(grad["next"], (y[:, :-1], y[:, 1:]), -1 / n)
        flat = both.reshape(-1, both.shape[2])
        grad["out"], grad["bias"] = flat.T @ de.reshape(-1, TAGS), de.sum((0, 1))
        dboth = de @ self.w["out"].T
        self._backward(x, "f", kf, dboth[:, :, :self.hidden], grad)
        self._backward(x[:, ::-1], "b", kb, dboth[:, ::-1, self.hidden:], grad)
        return float((z.sum() - score) / n), grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 250, batch: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        rng, loss = np.random.default_rng(seed), 0.0
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grad = self.loss(x[pick], y[pick])
            norm = max(1.0, np.sqrt(sum((g**2).sum() for g in grad.values())) / 5)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g / norm
                v[k] = 0.99 * v[k] + 0.01 * (g / norm) ** 2
                self.w[k] -= rate * (1 - 0.7 * s / steps) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        return loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag of each character, and its probability."""
        _, e, _, _ = self.states(x)
        a, b, z, steps = self._alphas(e)
        best, back = e[:, 0] + _START, []
        for t in range(1, x.shape[1]):
            all_ = best[:, :, None] + steps
            back.append(all_.argmax(1))
            best = all_.max(1) + e[:, t]
        tags = np.empty(x.shape, dtype=int)
        tags[:, -1] = (best + _END).argmax(1)
        for t in range(x.shape[1] - 2, -1, -1):
            tags[:, t] = back[t][np.arange(len(x)), tags[:, t + 1]]
        probability = np.exp(a + b - z[:, None, None])
        return tags, np.take_along_axis(probability, tags[:, :, None], 2)[:, :, 0]


def spans_of_tags(tags: np.ndarray, probability: np.ndarray) -> list[tuple[str, int, int, float]]:
    out, i = [], 0
    while i < len(tags):
        if tags[i] == O:
            i += 1
            continue
        kind, j = ("email" if tags[i] < 4 else KINDS[1 + (tags[i] - 4) // 2]), i + 1
        while j < len(tags) and tags[j] not in (O, E1, *BEGIN.values()) or j < len(tags) and tags[j] == E1 == tags[j - 1]:
            j += 1
        out.append((kind, i, j, float(probability[i:j].mean())))
        i = j
    return out


_LEAST = {"email": 0, "ip": 4, "card": 12, "phone": 7}


def plausible(kind: str, piece: str) -> bool:
    if kind == "email":
        return "." in piece.partition("@")[2].strip(".")
    n = len(_digits(piece))
    return piece[-1].isdigit() and n >= _LEAST[kind] and n <= (12 if kind == "ip" else 19 if kind == "card" else 15) and (kind != "ip" or piece.count(".") == 3)


def best_set(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of all proposals, those that don't overlap and weigh most together; a weight is probability times length."""
    merged: dict[Span, float] = {}
    for kind, a, b, p in spans:
        merged[kind, a, b] = max(p, merged.get((kind, a, b), 0.0))
    order = sorted(merged, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    total, take = [0.0], []
    for k, s in enumerate(order):
        before = int(np.searchsorted(ends[:k], s[1], side="right"))
        gain = total[before] + merged[s] * (s[2] - s[1])
        take.append((gain > total[-1], before))
        total.append(max(gain, total[-1]))
    out, k = [], len(order)
    while k:
        chosen, before = take[k - 1]
        if chosen:
            out.append((*order[k - 1], merged[order[k - 1]]))
        k = before if chosen else k - 1
    return out[::-1]


def windows_of(text: str) -> list[int]:
    """Starts of the windows that a text is decoded in: all of a fixed grid that hold an anchor."""
    found = sorted({m.start() // STRIDE for m in _ANCHOR.finditer(text)})
    return sorted({max(0, (k - j) * STRIDE) for k in found for j in range(DECODE // STRIDE)})


def tagged_spans(texts: list[str], tagger: Tagger, at_once: int = 512) -> list[list[tuple[str, int, int, float]]]:
    """Spans that the tagger finds in each text, all windows reconciled."""
    places = [(i, s) for i, t in enumerate(texts) for s in windows_of(t)]
    proposals: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    coded: dict[int, np.ndarray] = {}
    for k in range(0, len(places), at_once):
        part = places[k:k + at_once]
        x = np.full((len(part), DECODE), PAD)
        for row, (i, s) in enumerate(part):
            if i not in coded:
                coded = {i: classes(texts[i])}
            piece = coded[i][s:s + DECODE]
            x[row, :len(piece)] = piece
        tags, probability = tagger.decode(x)
        for (i, s), t, p in zip(part, tags, probability):
            for kind, a, b, q in spans_of_tags(t, p):
                b = min(b, len(texts[i]) - s)
                cut_left, cut_right = a == 0 and s > 0, b == DECODE and s + DECODE < len(texts[i])
                if b > a and not ((cut_left or cut_right) and b - a <= DECODE - STRIDE):
                    proposals[i].append((kind, s + a, s + b, q))
    return [best_set(p) for p in proposals]


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(rule spans, all spans) of each text; a tagger's span is added if it is sure, plausible and overlaps no rule's."""
    based = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in based]
    open_ = [i for i, t in enumerate(texts) if _ANCHOR.search(t)]
    added: dict[int, list[Span]] = {}
    for i, found in zip(open_, tagged_spans([texts[i] for i in open_], tagger)):
        free = [(k, a, b) for k, a, b, p in found if p >= SURE and plausible(k, texts[i][a:b]) and all(b <= u or a >= v for _, u, v in based[i])]
        added[i] = free
    return [(b, sorted([*b, *added.get(i, [])], key=lambda s: (KINDS.index(s[0]), s[1]))) for i, b in enumerate(based)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The window with its numbers in other spellings."""
    out, moved, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        piece = text[a:b]
        if a < at:
            continue
        if kind == "phone" and rng.random() < 0.4:
            piece = piece.lstrip("+")
        elif kind == "card" and rng.random() < 0.4:
            d, sign = _digits(piece), rng.choice([".", "/", " ", "-"])
            piece = sign.join(d[i:i + 4] for i in range(0, len(d), 4))
        out += text[at:a]
        moved.append((kind, len(out), len(out) + len(piece)))
        out += piece
        at = b
    return out + text[at:], moved


def fit_pii(docs: DataFrame, train_windows: int = TRAIN_WINDOWS) -> Tagger | None:
    """Train on at most ``train_windows`` windows around rule spans and as many without, in the order of a hash."""

    @F.pandas_udf("array<struct<window:string,labelled:boolean>>")
    def windows(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = base_spans(t)
            found = [(t[max(0, a - 20):a + WINDOW - 20], True) for _, a, _ in spans]
            if _ANCHOR.search(t):
                found += [(t[max(0, m.start() - 30):m.start() + WINDOW - 30], False) for m in re.finditer(r"[0-9@+][^0-9@+]{0,8}[^\n]{0,40}", t)]
            out.append(found)
        return pd.Series(out)

    found = docs.select(F.explode_outer(windows(whole_text())).alias("w")).where("w is not null").select("w.*").distinct()
    parts = [found.where(F.col("labelled") == side).orderBy(F.xxhash64("window"), "window").limit(train_windows) for side in (True, False)]
    rows = sorted((r["window"] for part in parts for r in part.collect()))
    if not rows:
        return None
    rng = np.random.default_rng(11)
    x, y = np.full((len(rows), WINDOW), PAD), np.zeros((len(rows), WINDOW), dtype=int)
    for k, window in enumerate(rows):
        text, spans = rewritten(window, base_spans(window), rng)
        text, spans = text[:WINDOW], [s for s in spans if s[2] <= WINDOW]
        x[k, :len(text)] = classes(text)
        y[k, :len(text)] = tags_of(len(text), spans, text)
    if not y.any():
        return None
    tagger = Tagger()
    tagger.train(x, y)
    return tagger


def report(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Counts and digest of the rules' spans, and all spans, of every row of ``docs``."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, every in all_spans(list(batch["text"]), tagger):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, schema)


def redacted(text: Column, tagger: Tagger | None) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, one replaces them all."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t, (_, spans) in zip(texts, all_spans(["" if t is None else t for t in texts], tagger)):
            if t is None or not spans:
                out.append(t)
                continue
            parts, at = [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return run(text)
