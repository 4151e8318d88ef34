"""The search over a list of sites, and what its pages may hold: deep documents, nested chrome, repeated keys."""

import glob
import json
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from postlode import rules
from postlode.functions import html as H, jsonld as J
from postlode.operators import crawl as C
from postlode.operators.dedupe import dedupe_postings
from postlode.plans.search import SearchSpec
from postlode.plans.sites import deal_texts, route_sites, search_sites, site_postings
from postlode.schema import RAW_DDL
from postlode.session import shared_dir
from postlode.sources.registry import select_sources
from postlode.sources.web import normalize_jsonld

SPEC = SearchSpec(as_of=date(2027, 3, 9))
LONG = "Keepers look after the lamp, the fog horn and the log book of the station, in all seasons and weathers. " * 2


def pages_of(spark, markup: dict):
    return spark.createDataFrame([(i, u, m) for i, (u, m) in enumerate(markup.items())], "page_id bigint, url string, html string")


def payload(provider, board, request_no, body):
    return (provider, board, request_no, "", body if isinstance(body, str) else json.dumps(body), None)


def listed(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "pos bigint, value string")


def opening(title):
    return f"<title>{title}</title><body><h1>{title}</h1><p>{LONG}</p></body>"


@pytest.fixture(scope="module")
def coast(spark):
    """Two crawled sites, one of which shares a board with the list itself."""
    pages = pages_of(spark, {
        "https://harbour.test/": '<a href="https://boards.greenhouse.io/dock">all</a><iframe src="https://jobs.lever.co/pier"></iframe>'
                                 '<a href="/jobs/keeper">k</a><a href="/jobs/pilot">p</a>',
        "https://harbour.test/careers": '<a href="/jobs/cook">c</a>',
        "https://harbour.test/jobs/keeper": opening("Light keeper"),
        "https://harbour.test/jobs/pilot": opening("Bar pilot"),
        "https://harbour.test/jobs/cook": opening("Ship's cook"),
        "https://reef.test/openings/7": '<script type="application/ld+json">{"@type":"JobPosting","title":"Diver"}</script>',
    })
    raw = spark.createDataFrame([
        payload("greenhouse", "dock", 1, {"jobs": [{"title": "Welder", "absolute_url": "https://boards.greenhouse.io/dock/1"}, {"title": "Rigger", "absolute_url": "https://boards.greenhouse.io/dock/2"}]}),
        payload("lever", "pier", 0, [{"text": "Crane driver", "hostedUrl": "https://jobs.lever.co/pier/a"}]),
        payload("lever", "pier", 1, [{"text": "Diver's mate", "hostedUrl": "https://jobs.lever.co/pier/b"}]),
        payload("remotive", None, 0, {"jobs": [{"title": "Remote clerk", "url": "https://remotive.com/1"}]}),
        payload("lever", "unasked", 0, [{"text": "Never seen", "hostedUrl": "https://jobs.lever.co/unasked/a"}]),
    ], RAW_DDL)
    return pages, raw


def titles(df):
    return [r["title"] for r in df.orderBy("seq").collect()]


def test_boards_stand_between_the_pages_of_their_site(spark, coast):
    out = site_postings(*coast, None, listed(spark, "reef.test/openings/7", "", "harbour.test", "remotive.com"), SPEC)
    # The second start page comes before what the first one links to; boards belong to the first one.
    assert titles(out) == ["Diver", "Welder", "Rigger", "Crane driver", "Diver's mate", "Light keeper", "Bar pilot", "Ship's cook", "Remote clerk"]
    places = {r["title"]: tuple(r["seq"]) for r in out.collect()}
    assert places["Welder"][0] == 2 and places["Welder"][2] == 0 and places["Crane driver"][2] == 1 and places["Light keeper"][2] == -1


def test_a_board_met_twice_is_kept_where_it_is_met_first(spark, coast):
    late = search_sites(*coast, None, listed(spark, "harbour.test", "https://jobs.lever.co/pier/x", "boards.greenhouse.io/dock"), SPEC)
    early = search_sites(*coast, None, listed(spark, "boards.greenhouse.io/dock", "harbour.test"), SearchSpec(as_of=SPEC.as_of, limit=3))
    assert len({r["url"] for r in late.collect()}) == late.count() == 7
    assert [r["title"] for r in early.collect()] == ["Welder", "Rigger", "Crane driver"]


def test_a_broken_payload_ends_its_site_alone(spark, coast):
    pages, raw = coast
    torn = raw.withColumn("payload", F.when((F.col("board") == "pier") & (F.col("request_no") == 1), "<html>").otherwise(F.col("payload")))
    out = site_postings(pages, torn, None, listed(spark, "harbour.test", "reef.test/openings/7", "boards.greenhouse.io/dock"), SPEC)
    assert titles(out) == ["Welder", "Rigger", "Crane driver", "Diver", "Welder", "Rigger"]


@pytest.fixture(scope="module")
def shared_boards(spark):
    """Six sites that link to the same two boards, of which one breaks; postings without an address among them."""
    order = [("boards.greenhouse.io/dock", "jobs.lever.co/pier"), ("jobs.lever.co/pier", "boards.greenhouse.io/dock")]
    pages = pages_of(spark, {f"https://quay{i}.test/": "".join(f'<a href="https://{b}">b</a>' for b in order[i % 2]) for i in range(6)})
    posted = [{"title": f"Mooring hand {n}", "absolute_url": "" if n % 5 == 0 else f"https://boards.greenhouse.io/dock/{n % 9}"} for n in range(20)]
    raw = spark.createDataFrame([
        *[payload("greenhouse", "dock", r, {"jobs": posted[r * 5:r * 5 + 5]}) for r in range(4)],
        *[payload("lever", "pier", r, [{"text": f"Crane driver {r}", "hostedUrl": f"https://jobs.lever.co/pier/{r}"}]) for r in range(3)],
        payload("lever", "pier", 3, "<html>"),
    ], RAW_DDL)
    return pages, raw, listed(spark, *(f"quay{i}.test" for i in (1, 0, 3, 2, 5, 4)), "jobs.lever.co/pier")


def test_first_places_leave_the_same_postings_after_the_removal_of_duplicates(spark, shared_boards):
    pages, raw, sites = shared_boards
    every = site_postings(pages, raw, None, sites, SPEC)
    first = site_postings(pages, raw, None, sites, SPEC, once=True)
    kept = [sorted((tuple(r["seq"]), r["title"], r["url"]) for r in dedupe_postings(p).collect()) for p in (every, first)]
    assert kept[0] == kept[1]
    # The board that breaks hides the other one on half of the sites: both orders count.
    assert {u for _, _, u in kept[1] if u} == {r["url"] for r in every.where("url <> ''").collect()}
    assert first.where("url = ''").count() == every.where("url = ''").count() > 4


def test_a_search_stores_a_board_posting_once_however_many_sites_link_to_it(spark, shared_boards):
    pages, raw, sites = shared_boards
    before = set(glob.glob(f"{shared_dir(spark)}/dedupe-rows-*"))
    search_sites(pages, raw, None, sites, SPEC).collect()
    (stored,) = set(glob.glob(f"{shared_dir(spark)}/dedupe-rows-*")) - before
    rows = spark.read.parquet(stored).where("url <> ''")
    assert rows.count() == rows.select("source", "title", "url").distinct().count()


@pytest.fixture(scope="module")
def busy_board(spark):
    """One board that thirty-two sites link to, its texts without any likeness and in one file, more than a dictionary holds."""
    chance = random.Random(5)
    texts = [f"{chance.getrandbits(16_000):x}" for _ in range(600)]
    posted = [{"title": f"Stoker {n}", "absolute_url": f"https://boards.greenhouse.io/busy/{n}", "content": t} for n, t in enumerate(texts)]
    raw = spark.createDataFrame([payload("greenhouse", "busy", r, {"jobs": posted[r * 10:r * 10 + 10]}) for r in range(60)], RAW_DDL).coalesce(1)
    pages = pages_of(spark, {f"https://wharf{i}.test/": '<a href="https://boards.greenhouse.io/busy">b</a>' for i in range(32)})
    return pages, raw, listed(spark, *(f"wharf{i}.test" for i in range(32))), texts


def test_a_written_result_holds_the_text_of_a_shared_posting_once(spark, busy_board, tmp_path):
    pages, raw, sites, texts = busy_board
    out = f"{tmp_path}/places"
    site_postings(pages, raw, None, sites, SPEC).select("seq.*", "title", "url", "description").write.parquet(out)
    back = spark.read.parquet(out)
    assert back.count() == back.select("site_pos", "url").distinct().count() == 32 * 600
    assert {r["description"] for r in back.select("description").distinct().collect()} == set(texts)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{out}/*.parquet")) < 1.5 * sum(map(len, texts))


def test_postings_are_dealt_out_for_many_places_alone(spark):
    rows = spark.range(9).selectExpr("'s' AS source", "id AS seq", "'u' AS url", "'t' AS title")
    assert deal_texts(rows, 0, 0) is rows and deal_texts(rows, 1_200_001, 4_800_003) is rows
    dealt = deal_texts(rows, 1_200_001, 4_800_004)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 9


def test_sites_without_payloads_or_boards(spark, coast):
    pages, raw = coast
    nothing = spark.createDataFrame([], RAW_DDL)
    assert "Light keeper" in titles(site_postings(pages, nothing, None, listed(spark, "harbour.test", "boards.greenhouse.io/dock"), SPEC))
    assert titles(site_postings(pages, raw, None, listed(spark, "https://harbour.test/jobs/keeper"), SPEC)) == ["Light keeper"]


def test_robots_and_budget_hold_for_every_site(spark, coast):
    robots = spark.createDataFrame([("https://harbour.test", 200, "User-agent: *\nDisallow: /jobs/pilot")], "origin string, status int, body string")
    out = site_postings(*coast, robots, listed(spark, "harbour.test"), SPEC)
    assert "Bar pilot" not in titles(out) and "Light keeper" in titles(out)
    assert titles(site_postings(*coast, None, listed(spark, "harbour.test"), SPEC, max_pages=1))[-1] == "Diver's mate"


def test_page_sources_in_a_list(spark):
    n = 8123456701
    pages = pages_of(spark, {
        "https://ninjajobs.org/jobs": '<a href="/job/x1">1</a>', "https://ninjajobs.org/job/x1": opening("Mast climber : Topsail"),
        rules.LINKEDIN_SEARCH + "?start=0": f'<div class="base-card" data-entity-urn="urn:li:jobPosting:{n}"><h3 class="base-search-card__title">Sail maker</h3></div>',
        rules.LINKEDIN_DETAIL + str(n): f'<div class="description__text"><p>{LONG}</p></div>',
    })
    raw = spark.createDataFrame([], RAW_DDL)
    rows = {r["title"]: r for r in site_postings(pages, raw, None, listed(spark, "www.linkedin.com/jobs", "ninjajobs.org"), SPEC).collect()}
    assert rows["Sail maker"]["source"] == "linkedin" and "fog horn" in rows["Sail maker"]["description"]
    assert rows["Mast climber"]["company"] == "Topsail" and rows["Mast climber"]["seq"]["site_pos"] == 1


def test_routes(spark):
    routed = route_sites(listed(spark, "b.test", "  ", "jobs.lever.co/q", "https://b.test/", "lever.co/q/5")).orderBy("site_pos").collect()
    assert [(r["site_pos"], r["source"]) for r in routed] == [(0, "b.test"), (2, "lever:q")]
    with pytest.raises(ValueError, match="gopher"):
        route_sites(listed(spark, "b.test", "gopher://b.test"))
    with pytest.raises(ValueError, match="linkedin"):
        select_sources(spark.createDataFrame([], RAW_DDL), ["linkedin"])
    assert site_postings(pages_of(spark, {"https://z.test/": "x"}), spark.createDataFrame([], RAW_DDL), None, listed(spark), SPEC).collect() == []


def test_a_crawl_reads_the_markup_of_visited_pages_only(spark, monkeypatch):
    start = "".join(f'<a href="/jobs/{i}">x</a>' for i in range(9))
    pages = pages_of(spark, {"https://m.test/": start} | {f"https://m.test/jobs/{i}": opening(f"Job {i}") for i in range(60)})
    read, cut = [], C.cut

    def watch(df, name):
        out = cut(df, name)
        if name == "crawl-level":
            read.append(out.where("links IS NOT NULL").count())
        return out

    monkeypatch.setattr(C, "cut", watch)
    visits = C.crawl(pages, spark.createDataFrame([("m", "https://m.test/", 0)], "site string, url string, pos int"), max_pages=6)
    assert visits.count() == sum(read) == 6


def deep(levels, inner):
    for i in range(levels):
        inner = {"@graph": [inner]} if i % 2 else [inner, {"@type": "Thing"}]
    return json.dumps(inner)


def test_postings_at_any_depth(spark):
    nested = {"@type": "JobPosting", "title": "Deep", "industry": [["a", ["b", ["c", ["d", ["e", ["f", {"name": {"name": "g"}}]]]]]]]}
    script = '<script type="application/ld+json">{}</script>'
    many = "".join(script.format(json.dumps({"@type": "JobPosting", "title": f"S{i}"})) for i in range(2500))
    pages = pages_of(spark, {
        "https://d.test/1": script.format(deep(30, nested)), "https://d.test/2": script.format('{"title":"old","@type":"Thing","@type":"JobPosting","title":"Last wins"}'),
        "https://d.test/3": many, "https://d.test/4": script.format("{JobPosting") + script.format('{"@type":"JobPosting","title":"0","name":"Zero"}'),
    })
    rows = normalize_jsonld(pages).collect()
    got = {r["title"]: r for r in rows}
    assert got["Deep"]["tags"] == ["a; b; c; d; e; f; g"] and "Last wins" in got and "0" in got
    assert len(rows) == 2503
    order = [r["title"] for r in sorted(rows, key=lambda r: r["seq"]) if r["title"].startswith("S")]
    assert order == [f"S{i}" for i in range(2500)]


def test_filled_goes_by_type(spark):
    texts = ['"0"', '"false"', '"[]"', '""', "0", "0.0", "false", "null", "[]", "{}", "7", "true", "[0]", '{"a":0}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", J.filled(F.try_parse_json("t")).isNotNull().alias("f")).collect()
    assert [r["t"] for r in rows if r["f"]] == ['"0"', '"false"', '"[]"', "7", "true", "[0]", '{"a":0}']


@pytest.mark.parametrize("markup, left", [
    ("a" + "<nav>x" * 6 + "</nav>" * 6 + "b", "ab"), ("a<form action='x'>never closed <p>q</p>", "a"), ("a</nav>b", "ab"), ("<FOOTER><form></FOOTER>after", "after"),
    ("a<form/>b", "ab"), ('<header title="x > y">t<nav>n</nav></header >z', "z"), ("<navy>kept</navy><nav-bar>too</nav-bar>", "<navy>kept</navy><nav-bar>too</nav-bar>"), ("", ""),
])
def test_dropped_elements(spark, markup, left):
    row = spark.createDataFrame([(markup,)], "h string").select(H.drop_elements(F.col("h"), rules.PAGE_CHROME).alias("r")).first()
    assert row["r"] == left
