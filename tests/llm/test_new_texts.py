"""Resampling, spelling variants and line removal against plain versions, on odd rows, skew and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlode.llm import line_dedup, mixing, neighbours, resampling, spelling

# Extra columns whose names clash with those that the operators use.
SCHEMA = "doc_id bigint, text string, key string, word int, row int, n bigint, k1 string, score string, block int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", None, 5) for i, t in rows], SCHEMA).repartition(parts)


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    rows = [(i, "\n".join(prose(rng, rng.randrange(0, 30), stems) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    shared = "A line that very many documents SHARE  "
    rows += [(100 + i, f"own {i} line of text\n  {shared.lower() if i % 2 else shared}\t\n{'x' * (i % 12)}") for i in range(80)]
    rows += [(None, None), (None, shared), (None, shared), (201, None), (202, ""), (203, "\n\n"), (204, " \t\x0b\x0c\r "), (205, shared), (205, shared), (205, "other text of one id"),
             (206, "Élan ÉLAN élan Élan's"), (207, "w " * 30_000 + "q" * 5000), (208, "日本語🎉 ßtraße-Straße"), (209, "twin line here\ntwin line here\ntwin line here")]
    return rows


def test_draw_equals_a_plain_version(spark, texts):
    target = spark.createDataFrame([(1, "abc dé abc"), (2, None), (3, "a line that share")], "item_id int, text string")
    got = Counter(tuple(r) for r in resampling.draw(table(spark, texts), target, percent=40, min_words=8, buckets=97, seed=3).collect())

    def features(text):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % 97 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    docs = [(i, *features(t)) for i, t in texts]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for r in target.collect() for b in features(r["text"])[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)}
    rows = []
    for i, words, found in docs:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    fit = sorted((r for r in rows if r[4] >= 8), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(fit) * 40 // 100
    want = Counter((*r[:4], k + 1) for k, r in enumerate(fit[:drawn]))
    want += Counter((*r[:4], None) for r in fit[drawn:] + [r for r in rows if r[4] < 8])
    assert got == want and drawn > 10


def test_draw_of_nothing(spark, texts):
    docs = table(spark, texts)
    target = spark.createDataFrame([], "item_id int, text string")
    assert resampling.draw(docs.where("false"), target).collect() == []
    assert all(r["rank"] is None for r in resampling.draw(docs, target, min_words=10**6).collect())
    assert {r["weight"] for r in resampling.draw(docs.where("doc_id = 202"), target).collect()} == {0}


@pytest.mark.parametrize("k", [1, 2, 499, 500, 999, 1000])
def test_kth_key_with_ties_in_all_but_the_last_part(spark, k):
    keys = [[v % 3 - 1, 0, v] for v in range(1000)]
    rows = spark.createDataFrame([(key,) for key in keys], "key array<bigint>").repartition(5)
    assert resampling.kth_key(rows, k, pivots=3) == sorted(keys)[k - 1]


def test_checksums_side_by_side():
    parts = [b"", b"a", b"word", b"x" * 39, b"x" * 40, b"x" * 41, "日本語".encode() * 99]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    state = resampling.crc_on(np.full(len(parts), 0xFFFFFFFF, np.uint32), data, ends - [len(p) for p in parts], ends)
    assert (state ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(p) for p in parts]


def plain_variants(rows, slip=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % slip == 0 else run] += 1
    v = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near, form = {w: [o for o in v if one_edit(w, o)] for w in v}, {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-v[o], o), default=None)
        if best is not None and v[best] >= 2 * v[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (v[w], len(near[w]), form.get(w), v.get(form.get(w)), root(w)) for w in v}


@pytest.mark.parametrize("block", [4096, 4])
def test_variants_equal_a_plain_version(spark, texts, block):
    rng = random.Random(8)
    # Chains of forms, words that differ at their first, middle and last letters, and one beginning that most words share.
    rows = texts + [(300 + i, " ".join(["colour", "colours", "color", "xcolour", "colouré", "aaaaa", "aaaaaa", "aaaaaaa"][: rng.randrange(1, 9)])) for i in range(40)]
    rows += [(400, " ".join(w for w in ("prefix" + a + b for a in "abcdefgh" for b in "abcdefgh") for _ in range(3 + (w < "prefixc")))), (401, ("l" * 700 + " ") * 3 + ("l" * 701 + " ") * 7)]
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_variants(table(spark, rows), slip=5, block=block).collect()}
    assert got == plain_variants(rows, slip=5) and len(got) > 60


def test_chains_of_forms_end_at_the_last(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [(f"leaf{i}", "w4") for i in range(50)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert len(got) == 61 and set(got.values()) == {"w11"}


def test_blocks_of_words_that_begin_alike_stay_small(spark):
    rows = spark.createDataFrame([("begin" + "".join(chr(97 + (i >> s) % 16) for s in (0, 4, 8, 12)), 3) for i in range(4096)], "word string, n bigint")
    sizes = [r["count"] for r in spelling.blocked(rows, block=64).groupBy("block").count().collect()]
    assert max(sizes) <= 256  # an interval of one letter: pairs of letters at most
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    last = float("inf")
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) < (last if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 16, 1 << 9])
def test_lines_equal_a_plain_version(spark, texts, bits, monkeypatch):
    # A filter that is far too small suspects nearly every line; the result is the same.
    monkeypatch.setattr(line_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    out = line_dedup.deduplicate(table(spark, texts, 7))
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect())
    assert got == plain_lines(texts) and sum(k[2] for k in got) > 70


def test_lines_of_nothing(spark, texts):
    assert line_dedup.deduplicate(table(spark, texts).where("false")).collect() == []
    assert [tuple(r) for r in line_dedup.deduplicate(table(spark, [(1, None)])).collect()] == [(1, 1, 0, "")]


def test_the_second_filter_misses_no_repeat(spark):
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(-2**62, 2**62, 50)) for _ in range(40)]
    again = np.unique(np.concatenate([lists[i][:5] for i in range(20)]))
    lists[39] = np.unique(np.concatenate([lists[39], again]))
    hashes = spark.createDataFrame([([int(h) for h in x],) for x in lists], "hashes array<bigint>").repartition(6)
    twice = line_dedup.twice_filter(hashes, 1 << 16)
    assert line_dedup._has(twice, again).all()
    assert line_dedup._has(twice, np.concatenate([x[5:40] for x in lists[20:39]])).mean() < 0.05


def test_scores_of_tiny_and_huge_vectors_equal_those_of_rescaled_ones(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    sizes = [1.0, 1e-170, 1e160, 5e-300, 1e300]
    plain = {}
    for scale in (False, True):
        rows = [(i, [float(v) for v in (row * sizes[i % 5] if scale else row)]) for i, row in enumerate(x)]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        plain[scale] = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 12)) for r in neighbours.search(vectors, neighbours.F.lit(True)).collect()}
    assert plain[True] == plain[False] and len(plain[True]) == 300


def test_what_is_decided_but_for_rounding_ends(spark):
    units = spark.createDataFrame([(f"u{i}", "s", 3.0, 1.0, p) for i, p in enumerate([1e-12] * 10 + [1 - 1e-12] * 3 + [0.5] * 4)], "unit string, source string, words double, rows double, p double")
    got = {r["unit"]: r["p"] for r in mixing.decide(units, 2, False).collect()}
    assert set(got.values()) == {0.0, 1.0} and all(got[f"u{i}"] == 0 for i in range(10)) and got["u10"] == got["u11"] == got["u12"] == 1
    assert sum(got.values()) == 5
