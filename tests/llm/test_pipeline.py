"""The corpus pipeline and the registered queries on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from postlode.llm import mixing, near_dedup, pii, queries, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "byte_bpe"
    before, after = seen["quality"]
    model = quality.fit_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score_quality(before, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == good
    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in near_dedup.report(before).collect() if r["kept"]}
    before, after = seen["pii"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert (r["text"] == texts[r["doc_id"]]) or pii.base_spans(texts[r["doc_id"]])
        assert not any(k == "email" for k, _, _ in pii.base_spans(r["text"]))
    before, after = seen["mixing"]
    assert after.count() == sum(r["taken"] // r["size"] for r in mixing.mix(before, partial=False).collect() if r["size"])
    assert seen["byte_bpe"][1].count() == after.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(str, cursor.fetchall()))
