import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from postlode.operators import crawl as C
from postlode.operators.filters import html_only
from postlode.operators.robots import may_fetch, robots_filter, rules_for
from postlode.schema import PAGES_DDL, RAW_DDL, ROBOTS_DDL


def test_robots_rules_match_the_standard_parser(apply):
    rng = random.Random(5)
    lines = ["User-agent: *", "user-agent: PostLode", "User-Agent: other", "Disallow: /jobs", "Allow: /jobs/1", "Disallow:", "Disallow: /a%20b", "Crawl-delay: 3",
             "", "# note", "Allow: / # all", "Disallow: /x?y=1", "nonsense", "Sitemap: http://s", "  Disallow : /b", "Request-rate: 1/5"]
    bodies = [rng.choice(["\n", "\r\n"]).join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    urls = ["https://o.test/jobs/1", "https://o.test/jobs", "https://o.test", "https://o.test/a b", "https://o.test/x?y=1&z", "https://o.test/b"]
    rows = [(b, rng.choice(urls)) for b in bodies]
    expected = []
    for body, url in rows:
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        expected.append(parser.can_fetch("postlode/1.0", url))
    assert apply(lambda a, b, *_: may_fetch(b, F.lit(200), rules_for(a, "postlode/1.0")), rows) == expected


def test_robots_filter_by_status(spark):
    pages = spark.createDataFrame([(i, f"https://h{i}.test/p", "", None, 200) for i in range(5)], PAGES_DDL)
    robots = spark.createDataFrame([("https://h0.test", 403, ""), ("https://h1.test", 500, ""), ("https://h2.test", 200, "User-agent: *\nDisallow: /p"),
                                    ("https://h3.test", None, None)], ROBOTS_DDL)
    assert sorted(r.page_id for r in robots_filter(pages, robots, "x").collect()) == [1, 3, 4]


def test_links_of_the_same_site(spark):
    html = """<a href="/jobs/1">1</a><a href='https://jobs.orbit.test/openings/2#apply'>2</a><a href="https://other.test/jobs/1">o</a><a href="/about">a</a>
      <a href="mailto:jobs@orbit.test">m</a><a href="/jobs/1">again</a><a name=x>n</a><a href="/careers/">self</a><!-- <a href="/jobs/9"> -->
      <script>'<a href="/jobs/8">'</script><a href="/jobsite">no</a><a HREF=/positions?x=1&amp;y=2>3</a>"""
    pages = spark.createDataFrame([(1, "https://www.orbit.test/careers", html, None, 200)], PAGES_DDL)
    assert [r.link for r in C.discover_job_links(pages).orderBy("pos").collect()] == [
        "https://www.orbit.test/jobs/1", "https://jobs.orbit.test/openings/2", "https://www.orbit.test/positions?x=1&y=2"]
    many = "".join(f'<a href="/job/{i}">x</a>' for i in range(60))
    assert C.discover_job_links(spark.createDataFrame([(1, "https://o.test/", many, None, 200)], PAGES_DDL)).count() == 50


def test_boards_once_each(spark):
    html = """<a href="https://boards.greenhouse.io/orbit">J</a><a href="https://boards.greenhouse.io/orbit/jobs/1">x</a>
      <iframe src="https://orbit.wd1.myworkdayjobs.com/en-US/Careers"></iframe><a href="https://lever.co">no</a><a href="https://orbit.wd1.myworkdayjobs.com/">no site</a>"""
    pages = spark.createDataFrame([(1, "https://orbit.test/careers", html, None, 200)], PAGES_DDL)
    assert [r.board_url for r in C.discover_boards(pages).collect()] == ["https://boards.greenhouse.io/orbit", "https://orbit.wd1.myworkdayjobs.com/en-US/Careers"]


def walk(pages, starts, blocked, max_pages, max_depth=2):
    """Breadth-first crawl of one site, page by page: pages[url] = (is_html, has_posting, board, links)."""
    queue, seen, done, visited, order = [(u, 0) for u in starts], set(), False, 0, []
    while queue and visited < max_pages:
        url, depth = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url in blocked or url not in pages:
            continue
        visited += 1
        is_html, posting, board, links = pages[url]
        if not is_html:
            order.append((url, depth, None))
            continue
        if posting:
            order.append((url, depth, "postings"))
            continue
        if depth == 0 and board:
            done = True
        new = [x for x in dict.fromkeys(links) if x not in seen]
        if len(new) >= 3 or (depth == 0 and new):
            order.append((url, depth, "listing" if depth < max_depth else "deep_listing"))
            if depth < max_depth:
                queue += [(x, depth + 1) for x in new]
        else:
            order.append((url, depth, "page" if depth > 0 or not done else "boards"))
    return order


@pytest.mark.parametrize("seed", range(2))
def test_crawl_equals_page_by_page_walk(spark, seed):
    rng = random.Random(seed)
    rows, sites = [], {}
    for s in range(6):
        base = f"https://s{s}.test"
        urls = [f"{base}/jobs/{i}" for i in range(rng.randint(5, 40))]
        pages = {}
        for u in urls:
            if rng.random() < 0.15:
                continue
            links = [rng.choice(urls) for _ in range(rng.choice([0, 1, 2, 4, 6]))]
            pages[u] = (rng.random() > 0.1, rng.random() < 0.2, rng.random() < 0.3, [x for x in links if x != u])
        starts = [urls[0], urls[1], urls[0]]
        blocked = {u for u in urls if u.endswith("3")}
        sites[f"s{s}"] = (pages, starts, blocked)
        for u, (is_html, posting, board, links) in pages.items():
            body = "".join(f'<a href="{x}">x</a>' for x in links) + ('<a href="https://jobs.lever.co/acme">b</a>' if board else "")
            body += '<script type="application/ld+json">{"@type":"JobPosting"}</script>' if posting else ""
            rows.append((len(rows), u, body, "text/html; charset=x" if is_html else "application/pdf", 200))
    budget = rng.randint(3, 12)
    df = spark.createDataFrame(rows, PAGES_DDL)
    seeds = spark.createDataFrame([(s, u, i) for s, (_, starts, _) in sites.items() for i, u in enumerate(starts)], "site STRING, url STRING, pos INT")
    deny = "User-agent: *\n" + "\n".join(f"Disallow: /jobs/{i}" for i in (3, 13, 23, 33))
    robots = spark.createDataFrame([(f"https://{s}.test", 200, deny.replace("/jobs/3\n", "/jobs/3\n")) for s in sites], ROBOTS_DDL)
    # "/jobs/3" also blocks "/jobs/30".. as a prefix, so the walk uses the same prefixes
    got = C.crawl(df, seeds, robots, max_pages=budget).collect()
    for s, (pages, starts, _) in sites.items():
        blocked = {u for u in pages if any(u.split(".test")[1].startswith(f"/jobs/{i}") for i in (3, 13, 23, 33))}
        mine = [(r.url, r.depth, r.role) for r in sorted((r for r in got if r.site == s), key=lambda r: (r.depth, r["rank"]))]
        assert mine == walk(pages, starts, blocked, budget)


def test_crawled_postings_and_boards(spark):
    body = "We are looking for a person who will defend our networks every day and who likes to learn new things with us."
    pages = spark.createDataFrame([
        (1, "https://o.test/", '<a href="/jobs/1">1</a><a href="/jobs/2">2</a><iframe src="https://jobs.lever.co/orbit"></iframe>', None, 200),
        (2, "https://o.test/jobs/1", '<script type="application/ld+json">{"@type":"JobPosting","title":"A"}</script>', None, 200),
        (3, "https://o.test/jobs/2", f"<h1>B</h1><p>{body}</p>", None, 200), (4, "https://o.test/jobs/3", "gone", None, 404)], PAGES_DDL)
    seeds = C.seeds_for(spark.createDataFrame([("https://o.test/",), ("jobs.lever.co/x",)], "value STRING"))
    assert sorted(r.url for r in seeds.collect()) == ["https://o.test/", "https://o.test/careers", "https://o.test/jobs"]
    visits = C.crawl(pages, seeds)
    found = C.crawl_postings(pages, visits).orderBy("seq").collect()
    assert [(r.title, r.source) for r in found] == [("A", "o.test"), ("B", "o.test")]
    raw = spark.createDataFrame([("lever", "orbit", 0, "", "[]", None), ("lever", "other", 0, "", "[]", None)], RAW_DDL)
    assert [r.board for r in C.board_payloads(visits, raw).collect()] == ["orbit"]
    assert C.site_preset(spark, "ninjajobs").count() == 2


def test_html_only(spark):
    pages = spark.createDataFrame([(1, "a", "", "text/html", 200), (2, "b", "", "image/png", 200), (3, "c", "", None, 200)], PAGES_DDL)
    assert sorted(r.page_id for r in html_only(pages).collect()) == [1, 3]
