"""Every driver query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from queries import oracles, spark_queries

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "pages", "region"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_check():
    assert set(spark_queries.queries()) == set(oracles.oracle_sql())
    assert set(spark_queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(spark_queries.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in rows)
    theirs = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in cursor.fetchall())
    assert mine == theirs


def test_a_crawl_grows_with_the_table_and_spends_its_whole_budget(spark):
    larger = SF.replace("sf0.001", "sf0.01")
    if larger == SF or not os.path.isdir(larger):
        pytest.skip("needs both small tables")
    pages = [{}, {}]
    for found, sf in zip(pages, (SF, larger)):
        for r in entry.queries()["crawl_many_sites"](spark, sf).collect():
            found[r.site] = found.get(r.site, 0) + 1
    assert len(pages[0]) < len(pages[1]) and max(pages[1].values()) == 25
    assert sum(pages[1].values()) > 48 and pages[1]["https://site0.example.com"] > 8
