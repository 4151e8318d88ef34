"""The search as a whole: each filter over one set of postings, order and limits, sheets and what is read back from them."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from postlode import rules
from postlode.operators import filters as P
from postlode.plans.search import SearchSpec, postings_filter, search_postings
from postlode.schema import ARRAY_COLUMNS, COLUMNS, POSTING_DDL, RAW_DDL
from postlode.sinks.write import cap_cells, infer_format, read_postings, to_sheet_rows, write_postings
from postlode.sources.raw import split_broken
from postlode.sources.registry import normalize, select_sources

TODAY = date(2027, 3, 9)


def days_ago(n):
    return (TODAY - timedelta(days=n)).isoformat()


@pytest.fixture
def postings(spark):
    def make(rows):
        """``rows``: the fields of each posting under its key, which becomes its company."""
        out = []
        for i, (key, given) in enumerate(rows.items()):
            rec = {c: [] if c in ARRAY_COLUMNS else "" for c in COLUMNS + ["description"]} | {"remote": "Unknown", "company": key} | given
            out.append(((0, "", 0, i), *[rec[c] for c in COLUMNS + ["description"]]))
        return spark.createDataFrame(out, POSTING_DDL)

    return make


BOARD = {
    "mill": dict(title="Kubernetes operator", remote="Remote", location="Oslo or anywhere", url="https://mill.test/a", posted_date=days_ago(1), description="Night-shift work on call."),
    "kiln": dict(title="Data scientist", remote="Hybrid", location="Porto", url="https://jobs.kiln.test/b", posted_date="Posted 6 Days Ago", tags=["night shift"], description="Clay."),
    "loom": dict(title="Weaver", remote="On-site", location="Turku", url="https://notkiln.test/c", posted_date=days_ago(7), description="Nightshifts never."),
    "quarry": dict(title="Stone mason", url="http://QUARRY.test", posted_date="ask us", description="Kubernetes is a plus; data  scientist colleagues."),
}


@pytest.mark.parametrize("wanted, kept", [
    (dict(), {"mill", "kiln", "loom", "quarry"}),
    (dict(keywords=["night shift"]), {"mill", "kiln"}),
    (dict(keywords=["kubernetes", "weaver"]), {"mill", "loom", "quarry"}),
    (dict(keywords=["kubernetes"], title_only=True), {"mill"}),
    (dict(fields=["data"]), {"kiln", "quarry"}),
    (dict(fields=["devops"], keywords=["clay"]), {"mill", "kiln", "quarry"}),
    (dict(require=["kubernetes", "data-scientist"]), {"quarry"}),
    (dict(exclude=["kubernetes", "clay"]), {"loom"}),
    (dict(remote_only=True), {"mill"}),
    (dict(remote_only=True, include_hybrid=True), {"mill", "kiln"}),
    (dict(include_hybrid=True), {"mill", "kiln", "loom", "quarry"}),
    (dict(locations=["OSLO", "turku"]), {"mill", "loom"}),
    (dict(domains=["www.kiln.test"]), {"kiln"}),
    (dict(domains=["kiln.test", "quarry.test"]), {"kiln", "quarry"}),
    (dict(exclude_domains=["https://kiln.test/x", "mill.test"]), {"loom", "quarry"}),
    (dict(posted_within_days=6), {"mill", "kiln"}),
    (dict(posted_within_days=7), {"mill", "kiln", "loom"}),
    (dict(posted_within_days=0, include_undated=True), {"quarry"}),
    (dict(keywords=["night shift"], remote_only=True, exclude=["porto"]), {"mill"}),
])
def test_each_filter(postings, wanted, kept):
    found = postings(BOARD).where(postings_filter(SearchSpec(as_of=TODAY, **wanted)))
    assert {r["company"] for r in found.collect()} == kept


@pytest.mark.parametrize("wrong, error", [(dict(limit=-1), ValueError), (dict(limit=0), ValueError), (dict(posted_within_days=-3), ValueError), (dict(fields=["pottery"]), KeyError)])
def test_wrong_requests(wrong, error):
    with pytest.raises(error):
        SearchSpec(as_of=TODAY, **wrong)


def test_word_edges_and_separators(apply):
    texts = ["night shift", "Night-Shift!", "nightshift", "night \n- shift", "nightshifts", "midnight shift", "F# and R&D", "F#x"]

    def hits(*terms):
        return [i for i, hit in enumerate(apply(lambda a, *_: P.match_any(a, list(terms)), texts)) if hit]

    assert hits("night shift") == [0, 1, 2, 3] and hits("NIGHT-shift", "  ") == [0, 1, 2, 3]
    assert hits("f#") == [6] and hits("r&d", "midnight") == [5, 6] and hits() == list(range(8))
    assert rules.expand_fields(["Data", "data"]) == rules.expand_fields(["data"])


def test_domains_from_a_table(postings, spark):
    listed = spark.createDataFrame([("kiln.test",), ("HTTP://www.Quarry.test/y",), ("",), (".",)], "domain STRING")
    df = postings(BOARD | {"none": dict(url="")})
    assert {r["company"] for r in P.domain_table_filter(df, listed).collect()} == {"kiln", "quarry"}
    assert {r["company"] for r in P.domain_table_filter(df, listed, deny=True).collect()} == {"mill", "loom", "none"}


@pytest.fixture(scope="module")
def landed(spark):
    """Two sources that share a job, and one that sends no JSON."""
    arbeitnow = {"data": [
        {"title": "Site reliability lead", "company_name": "Dyke", "url": "https://arbeitnow.test/1", "remote": True, "description": "<p>Tend the pumps.</p><h3>What you bring</h3><ul><li>4+ years of pump experience</li></ul>"},
        {"title": "Baker", "company_name": "Oven", "url": "https://arbeitnow.test/2", "description": "Bread."}]}
    remotive = {"jobs": [
        {"title": "SITE reliability LEAD ", "company_name": "dyke", "url": "https://remotive.test/8", "publication_date": days_ago(2), "description": "The same again, SRE."},
        {"title": "DevOps gardener", "company_name": "Hedge", "url": "https://remotive.test/9", "publication_date": days_ago(2) + "T07:30:00", "description": "<p>Master's degree preferred.</p>"}]}
    rows = [("remotive", None, 0, "", json.dumps(remotive), None), ("arbeitnow", None, 0, "", json.dumps(arbeitnow), None), ("remoteok", None, 0, "", "<!doctype html>", None)]
    return spark.createDataFrame(rows, RAW_DDL)


def test_a_search_from_payloads_to_rows(spark, landed):
    usable, lost = split_broken(landed)
    assert [(r["provider"], r["fault"]) for r in lost.collect()] == [("remoteok", "unreadable")]
    # Sources rank as they are named, so the copy on the second one goes.
    jobs = normalize(select_sources(usable, ["arbeitnow", "remotive"]), F.lit(TODAY))

    def found(**wanted):
        return [r["url"][-1] for r in search_postings(jobs, SearchSpec(as_of=TODAY, fields=["devops"], **wanted)).collect()]

    assert sorted(found()) == ["1", "9"] and found(limit=1) == ["1"] and found(posted_within_days=3) == ["9"]
    assert found(exclude=["pumps"]) == ["9"], "a posting that is filtered out still hides its copy"
    rows = {r["url"][-1]: r for r in search_postings(jobs, SearchSpec(as_of=TODAY, limit=9)).collect()}
    assert set(rows) == {"1", "2", "9"} and rows["9"]["posted_date"] == days_ago(2) and rows["9"]["education"] == "Master's"
    assert rows["1"]["experience"] == "4+ years" and rows["1"]["requirements"] == ["4+ years of pump experience"] and rows["1"]["remote"] == "Remote"


SHEET = {
    "+1 more": dict(title="@home", url="https://s.test/1", tags=["x", "y"], clearance=["Secret"], requirements=["one", "two"]),
    "plain": dict(title="a=b", url="https://s.test/2", description='says "hi",\nthen\tleaves'),
    " \x07-bell": dict(title="\r=x", url="https://s.test/3", description="é" * 50),
}


def test_cells_are_safe_in_a_sheet(postings):
    rows = {r["url"][-1]: r for r in to_sheet_rows(postings(SHEET), include_description=True).collect()}
    assert [rows[k]["company"] for k in "123"] == ["'+1 more", "plain", "' -bell"]
    assert rows["1"]["title"] == "'@home" and rows["2"]["title"] == "a=b" and rows["3"]["title"].startswith("'")
    assert (rows["1"]["tags"], rows["1"]["clearance"], rows["1"]["requirements"]) == ("x; y", "Secret", "one | two")
    capped = cap_cells(to_sheet_rows(postings(SHEET), include_description=True), 7).collect()
    assert max(len(v) for r in capped for v in r) == 7


@pytest.mark.parametrize("name", ["jobs.csv", "jobs.tab", "jobs.json"])
def test_written_appended_and_read_back(postings, spark, tmp_path, name):
    df, path = postings(SHEET), str(tmp_path / name)
    assert write_postings(df, path, include_description=True) == 3
    assert write_postings(df.where("url LIKE '%2'"), path, include_description=True, append=True) == 1
    back = read_postings(spark, path)
    assert back.columns == COLUMNS + ["description"] and back.count() == 4
    assert [r["description"] for r in back.where("url LIKE '%2'").collect()] == [SHEET["plain"]["description"]] * 2
    with pytest.raises(ValueError, match="columns"):
        write_postings(df, path, append=True)
    assert write_postings(df.limit(1), path) == 1 and read_postings(spark, path).count() == 1


def test_formats():
    assert {n: infer_format(n) for n in ("a.csv", "a.Tab", "a.JSON", "a.b/c", "a.txt")} == {"a.csv": "csv", "a.Tab": "tsv", "a.JSON": "json", "a.b/c": "csv", "a.txt": "csv"}
    assert infer_format("a.json", "TSV") == "tsv"
    for wrong in (("a.csv", "parquet"), ("book.xlsx",)):
        with pytest.raises(ValueError):
            infer_format(*wrong)
