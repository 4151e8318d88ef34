import random

import pytest

from postlode.operators.dedupe import dedupe_postings
from postlode.operators.distinct import distinct_first
from postlode.streaming.ingest import dedupe_batch

SCHEMA = "seq BIGINT, title STRING, company STRING, source STRING, url STRING"


def in_sequence(rows):
    """The rule, one row after the other."""
    urls, owner, kept = set(), {}, []
    for seq, title, company, source, url in sorted(rows):
        u, c = url.rstrip("/").lower(), company.strip().lower()
        t = f"{title.strip().lower()}|{c}"
        if (u and u in urls) or (c and owner.get(t, source) != source):
            continue
        urls.add(u)
        if c:
            owner.setdefault(t, source)
        kept.append(seq)
    return kept


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(r.seq for r in dedupe_postings(df, **kw).select("seq").collect())


def random_rows(rng):
    n, urls, titles = rng.randint(20, 300), rng.randint(2, 120), rng.randint(1, 40)
    return [
        (i, rng.choice(["A", " a", "B "]) + str(rng.randint(0, titles)), rng.choice(["", "  ", "X", "x ", "Y"]), f"s{rng.randint(0, 3)}",
         rng.choice(["", f"http://a/{rng.randint(0, urls)}", f"HTTP://A/{rng.randint(0, urls)}//"]))
        for i in range(n)
    ]


def test_two_windows_would_be_wrong(spark):
    rows = [(1, "k", "c", "s1", "u1"), (2, "k", "c", "s2", "u2"), (3, "k2", "c", "s3", "u2"), (4, "m1", "c", "s1", "v1"),
            (5, "m2", "c", "s1", "v1"), (6, "m2", "c", "s2", "v3")]
    assert in_sequence(rows) == run(spark, rows) == [1, 3, 4, 6]


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng)
    # Few rows count as hot here, so the salted joins are taken in turn.
    assert run(spark, rows, hot_rows=rng.choice([2, 10**6])) == in_sequence(rows)


def test_a_third_of_all_rows_under_one_key(spark):
    rng = random.Random(9)
    rows = [(i, "Hot", "Acme", f"s{i % 3}", f"http://h/{i}" if i % 2 else "") if i % 3 == 0
            else (i, f"t{i}", "Acme", "s1", "http://same/" if i % 3 == 1 else f"http://x/{rng.randint(0, 300)}") for i in range(1500)]
    assert run(spark, rows, hot_rows=50) == in_sequence(rows)


def test_long_chains(spark):
    """Each row rivals the next, by URL and by title in turn."""
    rows = [(i, f"t{(i + 1) // 2}", "c", f"s{i % 2}", f"u{i // 2}") for i in range(60)]
    assert run(spark, rows) == in_sequence(rows)


def test_no_rows_and_no_keys(spark):
    assert run(spark, [(1, "a", "", "s", ""), (2, "a", " ", "s2", "/")]) == [1, 2]
    assert dedupe_postings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(21)
    rows = random_rows(rng)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    kept = []
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        batch = spark.createDataFrame(rows[a:b], SCHEMA)
        for _ in range(2 if n == 1 else 1):  # the second batch is repeated, as after a failure
            got = [r.seq for r in dedupe_batch(batch, str(tmp_path), n).collect()]
        kept += got
    assert sorted(kept) == in_sequence(rows)


def test_distinct_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4)], "k STRING, o INT")
    assert sorted((r.k or "", r.o) for r in distinct_first(df, ["k"], "o").collect()) == [("", 4), ("a", 1), ("b", 2)]
    plan = distinct_first(df, ["k"], "o")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rows_of_equal_order_are_told_apart(spark):
    rows = [(1, "Baker", "Mill", "s1", "http://m/1"), (1, "Baker", "Mill", "s2", "http://m/2"), (2, "Cook", "Inn", "s1", "http://i/1"),
            (2, "Cook", "Inn", "s1", "http://i/1"), (3, "", "", "s1", ""), (3, "", "", "s1", "")]
    kept = dedupe_postings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.seq for r in kept) == [1, 2, 3, 3]
