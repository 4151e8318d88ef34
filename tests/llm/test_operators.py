"""Every training-data operator against a plain version of it, and on its edge cases."""

import gzip
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlode.llm import bpe, fingerprints, licenses, masked_lm, mixing, near_dedup, neighbours, pii, quality, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, size int, row int"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Missing, empty, tiny, long and repeated texts, missing and repeated ids, extra columns with clashing names."""
    texts = [(1, "one two three four five six seven"), (2, ""), (3, None), (None, "no id here at all my friend"), (5, "   \n\t "), (6, "Élan ÉLAN a"),
             (7, "w " * 30_000), (8, prose(1, 300)), (9, prose(1, 300)), (10, prose(1, 300) + " tail"), (10, "same id, other text"), (11, "twin"), (11, "twin"), (12, "日本語🎉 text")]
    return spark.createDataFrame([(i, t, "en", None if i == 8 else f"s{(i or 0) % 3}", 0, "x", 1, 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def shingles(text, lower):
    w = lower(text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(odd, empty):
    rows = fingerprints.edited_fingerprints(odd, k=64).collect()
    assert len(rows) == odd.count() and fingerprints.edited_fingerprints(empty).collect() == []
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["fingerprint"] == by[9]["fingerprint"] and by[3]["fingerprint"] == ""
    assert by[9]["near_next"] == 1.0 and by[8]["near_next"] < 0.1
    text, head = prose(1, 300), ("w " * 30_000)
    n = len(text)
    edited = text[:n - n // 2] + head[:n // 2]
    assert by[8]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    a, b = shingles(text, str.lower), shingles(edited, str.lower)
    assert abs(by[8]["near_edited"] - len(a & b) / len(a | b)) < 0.2
    assert abs(by[8]["n_distinct"] - len(a)) < 0.4 * len(a)


def test_merged_sketches(spark):
    parts = spark.createDataFrame([("a", prose(1, 80)), ("a", prose(2, 80)), ("b", prose(1, 80)), ("c", "")], "g string, text string")
    merged = fingerprints.merge_sketches(fingerprints.with_sketch(parts, "text", "s", k=32), ["g"], "s", k=32).collect()
    got = {r["g"]: r["s"] for r in merged}
    alone = fingerprints.with_sketch(parts, "text", "s", k=32).select("g", "s").collect()
    union = sorted({h for r in alone if r["g"] == "a" for h in r["s"]})[:32]
    assert got["a"] == union and got["c"] == [] and len(got["b"]) == 32


def test_quality(spark, odd, empty):
    docs = spark.createDataFrame([(i, prose(i, 60) if i % 3 else " ".join(w + "###" for w in prose(i, 60).split()), "en", "s", 0, "", 1, 1) for i in range(300)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, model).collect())
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).collect() == []
    assert {r["score"] for r in quality.score_quality(odd, quality.fit_quality(odd, labels.where("false"))).collect()} == {0.5}


def test_additive_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9
    margin = np.full(1000, model.intercept)
    for row, bins in enumerate(model.bins(x[3000:])):
        margin[row] += sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i] // 4, bins[j] // 4] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert np.allclose(margin, model.margin(model.bins(x[3000:])))


def test_byte_bpe(spark, odd, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Ranks(path).ids, special_tokens={})
    extra = spark.createDataFrame([(i, t, "", "", 0, "", 0, 0) for i, t in enumerate(["it's  WE'LL \n\n x y　 z", "<|endoftext|>", "\x1c a\x85b", "a" * 400, "12345 ½ ٣", "​ ｶﾅ ça" * 5], 100)], SCHEMA)
    docs = odd.where("doc_id is null or doc_id != 7").union(extra)
    rows = bpe.round_trip(docs, path, P.PATTERN).collect()

    def digests(text):
        ids = plain.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(str, ((r["doc_id"], *digests(r["text"])) for r in docs.collect()))) == sorted(str(tuple(r)) for r in rows)
    assert bpe.round_trip(empty, path, P.PATTERN).collect() == []


def test_byte_bpe_constants_and_folded_words(spark, monkeypatch):
    """A session's constants are made once; a task folds a word again only when it no longer holds it, with the same ids."""
    path = P.path("byte_bpe_50k.tiktoken")
    t = bpe.tokenizer(spark, path, P.PATTERN)
    assert bpe.tokenizer(spark, path, P.PATTERN) is t
    docs = spark.createDataFrame([(i, f"zqxjv zqxjv{i % 3} wvvkq{i}" * 2) for i in range(40)], "doc_id long, text string").coalesce(1)
    no_words = spark.createDataFrame([], "word string, ids array<int>")
    monkeypatch.setattr(t, "dictionary", lambda docs: no_words)
    monkeypatch.setattr(bpe, "ROWS", 1)
    results = []
    for held in (2, bpe.HELD):
        monkeypatch.setattr(bpe, "HELD", held)
        results.append(sorted((r["doc_id"], r["ids"]) for r in t.encode(docs).collect()))
    monkeypatch.undo()
    assert results[0] == results[1] == sorted((r["doc_id"], r["ids"]) for r in t.encode(docs).collect())


def test_byte_bpe_held_ids():
    """A task folds a word it holds only once, keeps all ids in one array, and forgets them when they are too many."""
    import pyarrow as pa

    folds, ranks = [], {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}

    class Counted(dict):
        def get(self, key, default=None):
            folds.append(key)
            return super().get(key, default)

    lists = [["abab", "x", "given", ""], None, [], ["x", "abab", "y" * 100]]
    held = bpe.Held(Counted(given=np.array([7, 8, 9], dtype=np.int32).tobytes()), ranks)
    want = [[257, 120, 7, 8, 9], [], [], [120, 257] + [121] * 100]
    for _ in range(2):
        got = bpe.numbers(pa.array([x or [] for x in lists], pa.list_(pa.string())), held)
        assert got.to_pylist() == want and bpe.numbers(got_slice := pa.array(lists[:1] * 3 + lists[3:]).slice(2), held).to_pylist() == [want[0], want[3]] and len(got_slice) == 2
    assert sorted(folds) == ["", "abab", "given", "x", "y" * 100] and held.used == len(held.ids[:held.used]) == 1 + 1 + 3 + 100
    held.used = 16 * bpe.HELD + 1
    assert held.numbers_of(["x"]).tolist() == [0] and held.used == 1


def test_licenses(spark, odd, empty):
    texts = ["Under the MIT License. under THE mit-license!", "Apache License, Version 2.0", "CC BY-NC 4.0 cc by nc", "apache license version 3", "under the mit",
             "x Permission is hereby granted free of charge kindly to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "GNU General Public License"]
    docs = odd.union(spark.createDataFrame([(100 + i, t, "", "", 0, "", 0, 0) for i, t in enumerate(texts)], SCHEMA))
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and licenses.scan(empty).collect() == []

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))

    assert sorted(str((r["doc_id"], *plain(r["text"]))) for r in docs.collect()) == sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows)
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[105] == "mit-grant" and labels[106] == "gpl" and labels[103] == "" and labels[100] == "mit"


def test_near_dedup(spark, odd, empty):
    rng = random.Random(4)
    rows = [(1000 + i, prose(i // 3, 120), "", "", 0, "", 0, 0) for i in range(30)]
    base = prose(77, 150).split()
    for i in range(60):
        words = base[:]
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((2000 + i, " ".join(words), "", "", 0, "", 0, 0))
    docs = odd.union(spark.createDataFrame(rows, SCHEMA))
    got = near_dedup.report(docs).collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    plain = [(r["doc_id"], shingles(r["text"], lower)) for r in docs.collect()]
    label = list(range(len(plain)))
    for _ in range(len(plain)):
        before = label[:]
        for i, (_, a) in enumerate(plain):
            for j, (_, b) in enumerate(plain):
                if i != j and a and b and 4 * len(a & b) >= 3 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    groups = {}
    for at, (doc_id, _) in zip(label, plain):
        groups.setdefault(at, []).append(doc_id)
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    expected = [(doc_id, len(s), smallest[at]) for at, (doc_id, s) in zip(label, plain)]
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    with_words = {k for k, (at, (_, s)) in enumerate(zip(label, plain)) if s}
    assert kept.where(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))) > 0).count() == len({label[k] for k in with_words})
    assert near_dedup.report(empty).collect() == [] and near_dedup.keep_one(empty).count() == 0


def test_near_dedup_bitmaps():
    rng = np.random.default_rng(3)
    for n in (9, 70, 400, 900):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(n) < keep], rng.integers(0, 1 << 63, n // 30, dtype=np.uint64)])) for keep in (0.99, 0.95, 0.9, 0.8, 0.7, 0.5)]
        sizes = np.array([len(s) for s in sets])
        block = near_dedup.Classes(np.arange(6), np.arange(6), sizes, np.zeros(6, dtype=np.int64), np.concatenate([near_dedup.bitmap(s) for s in sets]).view(np.int64))
        found = set(zip(*(x.tolist() for x in near_dedup.possible(block, block, True, 75)[:2])))
        links = {(i, j) for i in range(6) for j in range(i + 1, 6) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
        assert links <= found and (n < 70 or links and len(found) < 15)


def test_near_dedup_of_texts_not_alike_enough(spark, monkeypatch):
    """A group of texts that meet in tables but are no links: hardly any pair is compared, in whatever blocks they are."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng, base, rows = random.Random(8), prose(78, 150).split(), []
    for i in range(120):
        words = base[:]
        for k in rng.sample(range(0, 150, 5), 2 if i < 20 else 7):
            words[k] = f"new{i}"
        rows.append((i, " ".join(words), "", "", 0, "", 0, 0))
    compared, confirm = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirm(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(120)}
    assert sum(compared) < 600


def test_warc(spark):
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://b.example", "<p>é</p>"), (3, None, None), (4, "http://c.example/", ""), (5, "u\r\nX: y", "a\r\n\r\nWARC/1.1\r\n"), (5, "u\r\nX: y", "a\r\n\r\nWARC/1.1\r\n"), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, k1 string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == 6 and warc.archive_round_trip(pages).count() == 7
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"], got[3]["refers_to"]) == ("revisit", 2, "response", 4)
    assert got[5]["payload_bytes"] == 15 and got[None]["record_type"] == "response"
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_level(spark, tmp_path):
    """Archives are compressed at the fastest level."""
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", prose(i, 400)) for i in range(40)], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(pages).coalesce(1), str(tmp_path / "level"))
    (archive,) = (tmp_path / "level").glob("part-*.gz")
    packed = archive.read_bytes()
    data = gzip.decompress(packed)
    fast, usual = (len(gzip.compress(data, level)) for level in (1, 6))
    assert abs(len(packed) - fast) < abs(len(packed) - usual)


def test_warc_assembly(spark):
    kinds = [("r", "response", None), ("q", "request", ["r"]), ("m", "metadata", ["q"]), ("alone", "request", ["gone"]), ("q", "request", ["r"])]
    filled = {n: None for n in warc.RECORD_NAMES} | {"broken": False, "n_content": 0}
    rows = [tuple((filled | {"record_id": i, "type": k, "concurrent_to": c})[n] for n in warc.RECORD_NAMES) for i, k, c in kinds]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert len(got["r"]["requests"]) == 1 and len(got["r"]["metadata"]) == 1 and got["gone"]["response"] is None
    damaged = b"WARC/1.1\r\nContent-Length: 99999\r\n\r\nx\r\nWARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert [r["broken"] for r in warc.parse_archive(damaged)] == [True, False]


def test_neighbours_of_equal_cosine_by_smaller_id(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-9, 9, 16).astype(float)
    # Rescaled copies, ids dealt against the scale; and unit vectors along axes, all at right angles.
    scaled = [((i * 37) % 61, (base * 2.0 ** (i - 30)).tolist()) for i in range(61)]
    axes = [(1000 + (i * 11) % 40, np.eye(40)[i].tolist()) for i in range(40)]
    vectors = spark.createDataFrame(scaled + axes, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.search(vectors, F.lit(True)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for ids in ([i for i, _ in scaled], [i for i, _ in axes]):
        for q in ids:
            assert [got[q][k][0] for k in range(1, 6)] == [i for i in sorted(ids) if i != q][:5]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(float)
    x[10:200] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (1499, x[1499].tolist()), (2050, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(1))
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        near = unit @ unit[q]
        near[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(near, 12)))[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - near[v]) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits >= 0.9 * 150 and 2050 not in got and 2000 not in got
    assert [v for _, v, _ in sorted(got[50])] == [9, 10, 11, 12, 13]
    assert neighbours.search(vectors.where("false"), F.lit(True)).count() == 0


def test_mixing(spark, odd, empty):
    rng = random.Random(9)
    rows = [(i, prose(i, rng.randrange(1, 90)), "", f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}", 0, "", 0, 0) for i in range(2600)]
    docs = odd.where("doc_id != 7").union(spark.createDataFrame(rows, SCHEMA))
    got = mixing.report(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, held = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        share = {s: rest * weight[s] / sum(weight[t] for t in order if t not in held) for s in order if s not in held}
        over = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not over:
            break
        held |= over
    for s in order:
        own = [r for r in got if r["source"] == s]
        target = share.get(s, 3 * sizes[s])
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(docs.repartition(3)).collect()))
    assert mixing.report(empty).collect() == [] and mixing.take(docs).columns == docs.columns


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, x = rng.uniform(0, 1, 500), np.column_stack([np.ones(500), rng.integers(1, 900, 500)])
    q = mixing.flight(p, x, rng)
    assert np.allclose(x.T @ p, x.T @ q) and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    mean = np.mean([mixing.flight(p[:40], x[:40], np.random.default_rng(s)) for s in range(400)], axis=0)
    assert np.abs(mean - p[:40]).max() < 0.12


def test_masked_lm(spark, odd, empty):
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["the red fox ran home", "a big dog sat down"]) for _ in range(20)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", 0, 0) for i, t in enumerate(lines)], SCHEMA)
    model = masked_lm.fit_masked_lm(docs, rounds=4)
    words = lines[0].split()
    rng.shuffle(words)
    known, net = model[0], masked_lm.Network().load(model[1])
    (n, ordered), (_, mixed), none = masked_lm.document_scores([lines[0], " ".join(words), ""], known, net)
    assert n == 100 and ordered > mixed and none == (0, 0.0)
    ids = masked_lm.ids_of(masked_lm.words_of(lines[0]), known)
    one_by_one = sum(float(net.log_prob(masked_lm.contexts(ids, np.array([i])), ids[[i]])[0]) for i in range(len(ids)))
    assert abs(one_by_one - ordered) < 1e-2
    assert masked_lm.score_documents(odd, model).count() == odd.count() and masked_lm.score_documents(empty, masked_lm.fit_masked_lm(empty)).count() == 0


def test_masked_lm_words_that_share_an_id(spark):
    frequent = " ".join(f"w{i}" for i in range(masked_lm.WORDS))
    of = lambda w: zlib.crc32(w.encode()) % masked_lm.HASHED
    junk = next(w for i in range(100_000) if of(w := f"junk{i}") == of("seldom"))
    other = next(w for i in range(100_000) if of(w := f"other{i}") == of("seldom"))
    texts = [frequent] * 4 + ["seldom seldom seldom " + other]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", 0, 0) for i, t in enumerate(texts)], SCHEMA)
    model = masked_lm.fit_masked_lm(docs, rounds=1)
    assert len(model[0]) == masked_lm.WORDS and {bytes(r.word): r.n for r in model[2].collect()} == {b"seldom": 3, other.encode(): 1}
    asked = ["seldom", other, junk, "seldom seldom", "w1 SELDOM w2", f"w1 {junk} w2", "w1", None, "seldom"]
    rows = spark.createDataFrame([(i, t, "", "", 0, "", 0, 0) for i, t in enumerate(asked)], SCHEMA)
    got = {r.doc_id: r for r in masked_lm.score_documents(rows, model).collect()}
    net = masked_lm.Network().load(model[1])
    ids = masked_lm.document_scores([t or "" for t in asked], model[0], net)
    share = {0: np.log(4 / 7), 1: np.log(2 / 7), 2: np.log(1 / 7), 3: 2 * np.log(4 / 7), 4: np.log(4 / 7), 5: np.log(1 / 7), 6: 0, 7: 0, 8: np.log(4 / 7)}
    for i, (n, log_prob) in enumerate(ids):
        assert got[i].n_words == n and abs(got[i].log_prob - log_prob - share[i]) < 1e-4
    assert got[0].log_prob > got[1].log_prob > got[2].log_prob and got[4].mean_log_prob > got[5].mean_log_prob and got[7].mean_log_prob is None


def test_masked_lm_trains_on_every_position(spark):
    for n, rounds in ((1, 2), (3, 2), (50, 2), (50, 1), (50, 7), (5, 7)):
        every = np.concatenate([masked_lm.targets("some text", n, turn, rounds) for turn in range(rounds)])
        assert sorted(every) == list(range(n))
    # Texts of one to three words, alike in their first 64 characters: every last word is learnt.
    head = "h" * 70
    texts = [head, f"{head} mid{{}}", f"{head} mid{{}} end{{}}"]
    lines = [t.replace("{}", str(i)) for t in texts for i in range(4)] * 60
    docs = spark.createDataFrame([(i, t, "", "", 0, "", 0, 0) for i, t in enumerate(lines)], SCHEMA)
    known, weights, _ = masked_lm.fit_masked_lm(docs)
    net = masked_lm.Network().load(weights)
    start = masked_lm.Network()
    for text in {t for t in lines}:
        ids = masked_lm.ids_of(masked_lm.words_of(text), known)
        at = np.arange(len(ids))
        assert (net.log_prob(masked_lm.contexts(ids, at), ids) > start.log_prob(masked_lm.contexts(ids, at), ids) + 0.5).all()


def test_masked_lm_on_arrays(spark, monkeypatch):
    """Words, ids and examples made on arrays are those of single texts, in the same steps; told shares spare the join only."""
    import pyarrow as pa

    texts = ["", "  a B\tc\n", "\x1c x\x1dy \x85z", "É À　b\xa0c", "\x0b\x0cq", " ", "日本 🎉Ab", "a\x00b \x1f c", "seldom a", prose(1, 300), prose(2, 50) + " a a"]
    known = {b"a": 0, b"c": 1}
    for some in (pa.array(texts), pa.array(texts).slice(3, 6), pa.array([], pa.string())):
        sizes, words = masked_lm.split_words(some)
        plain = [masked_lm.words_of(t) for t in some.to_pylist()]
        assert sizes.tolist() == [len(p) for p in plain] and words.to_pylist() == [w for p in plain for w in p]
        assert masked_lm.chunk_ids(some, known)[1].tolist() == [i for p in plain for i in masked_lm.ids_of(p, known)]
    monkeypatch.setattr(masked_lm, "BATCH", 16)
    monkeypatch.setattr(masked_lm, "AT_ONCE", 4)
    for turn in (0, 1):
        got = list(masked_lm.examples(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])] * 2), known, turn, 2))
        around, word, steps, waiting = [], [], [], 0
        for text in texts * 2:
            ids = masked_lm.ids_of(masked_lm.words_of(text), known)
            at = masked_lm.targets(text, len(ids), turn, 2)
            around += masked_lm.contexts(ids, at).tolist()
            word += ids[at].tolist()
            waiting += len(at)
            if waiting >= 16:
                steps += [min(16, waiting - k) for k in range(0, waiting, 16)]
                waiting = 0
        assert np.concatenate([a for a, _ in got]).tolist() == around and np.concatenate([w for _, w in got]).tolist() == word
        assert [len(w) for _, w in got] == steps + [waiting] * (waiting > 0)
    docs = spark.createDataFrame([(i, t, "", "", 0, "", 0, 0) for i, t in enumerate([*texts, None])], SCHEMA)
    counts = masked_lm.word_counts(docs)
    known = masked_lm.vocabulary(counts, 5)
    model = known, masked_lm.Network().flat(), masked_lm.hashed_words(counts, known)
    assert len(masked_lm.frequent_shares(model[2], 3)) == 3
    scores = []
    for told in ({}, masked_lm.frequent_shares(model[2], 20), masked_lm.frequent_shares(model[2])):
        monkeypatch.setattr(masked_lm, "frequent_shares", lambda hashed: told)
        scores.append(sorted((r.doc_id, r.n_words, r.log_prob) for r in masked_lm.score_documents(docs, model).collect()))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == docs.count()


def test_masked_lm_far_apart():
    """Weights whose exponentials don't fit into 32 bits still give probabilities."""
    net = masked_lm.Network()
    net.w["class_b"][:2] = 500, -500
    net.w["word_b"][0, :2] = 300, 100
    got = net.log_prob(np.zeros((3, 4), dtype=int), np.array([0, 1, 64]))
    assert np.isfinite(got).all() and abs(got[0]) < 1e-3 and got[1] < -60 and got[2] < -60
    assert all(np.isfinite(g).all() for g in net.gradient(np.zeros((3, 4), dtype=int), np.array([0, 1, 64])).values())


def test_masked_lm_gradient():
    net, rng = masked_lm.Network(), np.random.default_rng(0)
    around, word = rng.integers(0, masked_lm.SIZE, (6, 4)), rng.integers(0, masked_lm.SIZE, 6)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    grad = net.gradient(around, word)
    for name in ("shift", "place", "class_w"):
        at = tuple(0 for _ in net.w[name].shape)
        values = []
        for d in (1e-4, -1e-4):
            net.w[name][at] += d
            values.append(-net.log_prob(around, word).mean())
            net.w[name][at] -= d
        assert abs((values[0] - values[1]) / 2e-4 - grad[name][at]) < 1e-4


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(pii._digits(m[0])) <= 19 and pii.luhn(pii._digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(pii._digits(m[0])) <= 15]
    return out


def test_rule_spans():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("a.@-+1234560 ()é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("x 4539 1488 0343 6467 y 1.2.3.4.5 a@b.co@d.org") == plain_spans("x 4539 1488 0343 6467 y 1.2.3.4.5 a@b.co@d.org")


def test_tagger(spark, odd, empty):
    rng = random.Random(6)

    def fact():
        return rng.choice([f"{rng.choice('abcdefg') * 3}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
                           ".".join(str(rng.randrange(256)) for _ in range(4)), "4539148803436467", f"room {rng.randrange(99)}", f"v{rng.randrange(9)}.{rng.randrange(9)}"])

    docs = spark.createDataFrame([(100 + i, f"{prose(i, 20)} {fact()} {prose(i + 500, 20)} {fact()}", "", "", 0, "", 0, 0) for i in range(250)], SCHEMA)
    tagger = pii.fit_pii(docs, train_windows=400)
    rows = {r["doc_id"]: r for r in pii.report(docs, tagger).collect()}
    for r in docs.collect():
        base = plain_spans(r["text"])
        assert rows[r["doc_id"]]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert {pii.written([s]) for s in base} <= set(rows[r["doc_id"]]["spans"].split(","))
    texts = [f"{prose(i, 30)} call (4{i:02d}) 555-27{i:02d} {prose(i, 30)}" for i in range(20)]
    found = pii.tagged_spans([r["text"] for r in docs.collect()], tagger)
    based = [plain_spans(r["text"]) for r in docs.collect()]
    good = sum(any(k == s[0] and a < s[2] and b > s[1] for k, a, b, _ in f) for f, base in zip(found, based) for s in base)
    assert good >= 0.8 * sum(map(len, based))
    assert pii.report(odd, tagger).count() == odd.count() and pii.fit_pii(empty) is None and pii.report(empty, None).count() == 0
    long = "é" * 70_000 + " abc.12@mail3.example.com " + texts[0] * 3
    (whole,) = pii.all_spans([long], tagger)
    assert whole[0][0] == ("email", 70_001, 70_025)
    redacted = docs.limit(5).select(pii.redacted(F.col("text"), tagger).alias("t")).collect()
    assert all("@mail" not in r["t"] for r in redacted)


def test_crf_gradient():
    tagger, rng = pii.Tagger(hidden=3), np.random.default_rng(0)
    text = "mail a.b@c.de or +1 (415) 555-2671"
    x, y = pii.classes(text)[None], pii.tags_of(len(text), plain_spans(text), text)[None]
    _, grad = tagger.loss(x, y)
    for name in ("xf", "hb", "out", "bias", "next"):
        at = tuple(rng.integers(0, s) for s in tagger.w[name].shape)
        values = []
        for d in (1e-5, -1e-5):
            tagger.w[name][at] += d
            values.append(tagger.loss(x, y)[0])
            tagger.w[name][at] -= d
        assert abs((values[0] - values[1]) / 2e-5 - grad[name][at]) < 1e-4
