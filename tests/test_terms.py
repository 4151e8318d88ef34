"""The term table against patterns tried one by one, by both ways of looking terms up."""

import pytest
from pyspark.sql import functions as F

from postlode import rules
from postlode.operators import filters as P

TERMS = ["tide", "tide table", "fog-horn", "C++", ".NET core", "a/b test", "+", "-", "ÉCLAIR", "lamp room keeper", "  ", "x", "Straße", "deep  sea-diver", "n.o.s.",
         " ".join(f"word{i}" for i in range(30))]
TEXTS = ["Tide tables and a TIDETABLE, tide-table", "foghorn fog horn Fog--Horn", "c++ C+", ".net core and .netcore, dotnet core", "an a/b test, A/B-test", "1 + 1", "", None, "éclair",
         "lamp-roomkeeper lamproom", "lamproomkeeper", "deepsea diver deep seadiver", "straße STRASSE", "N.O.S. nos", " ".join(f"word{i}" for i in range(31)), "".join(f"word{i}" for i in range(30)), "tide" * 3, "x" * 20_000]


@pytest.mark.parametrize("most", [20_000, 3])
def test_term_table(spark, monkeypatch, most):
    monkeypatch.setattr(P, "ROW_LOCAL_TERMS", most)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "posting_id int, text string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    out = P.term_matches(rows.where("text IS NOT NULL"), terms, F.col("text"))
    got = sorted((r["posting_id"], r["term"]) for r in out.collect())
    want = rows.select("posting_id", *[F.col("text").rlike(rules.term_pattern(t)).alias(f"t{i}") for i, t in enumerate(TERMS)]).collect()
    assert got == sorted((r["posting_id"], t) for r in want for i, t in enumerate(TERMS) if t.strip() and r[f"t{i}"])
    assert (14, TERMS[-1]) in got and (15, TERMS[-1]) in got
    if most > 3:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Subquery")[0], "texts are not moved"


def test_no_terms(spark):
    rows = spark.createDataFrame([(1, "tide")], "posting_id int, text string")
    assert P.term_matches(rows, spark.createDataFrame([(" ",)], "term string"), F.col("text")).collect() == []
