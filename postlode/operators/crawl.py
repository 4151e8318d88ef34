"""Crawling a landed page table: links, boards, reachability and page roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions import html as H, jsonld as J, urls as U
from ..functions.core import let, unnest
from ..session import cut
from ..sources.web import normalize_html_page, normalize_jsonld
from .distinct import distinct_first
from .robots import robots_verdicts

_BOARD = "array<struct<source:string,provider:string,board:string,url:string>>"


def job_links(page: Column, url: Column, pattern: str = rules.JOB_LINK, limit: int = rules.LINKS_PER_PAGE) -> Column:
    """Distinct links of a page that look like job pages of the same site, in page order."""
    site = U.bare_host(url)
    self_url = F.rtrim(url, F.lit("/"))

    def wanted(link: Column) -> Column:
        h = U.host(link)
        return (
            U.is_job_link(link, pattern)
            & U.scheme(link).isin("http", "https")
            & ((h == site) | h.endswith(F.concat(F.lit("."), site)))
            & (F.rtrim(link, F.lit("/")) != self_url)
        )

    found = F.transform(H.anchors(page), lambda ref: U.resolve(url, ref))
    return F.slice(F.array_distinct(F.filter(found, wanted)), 1, limit)


def board_links(page: Column, url: Column) -> Column:
    """Hosted boards a page links to or embeds: one entry per board, the first URL winning."""
    absolute = F.transform(H.references(page, ["a", "iframe", "script"]), lambda ref: U.join_url(url, ref))
    hosted = F.filter(
        absolute, lambda u: U.scheme(u).isin("http", "https") & U.host(u).rlike(rules.BOARD_HOSTS)
    )
    routed = F.transform(
        hosted,
        lambda u: let(
            U.route(u),
            lambda r: F.struct(
                r["source"].alias("source"), r["provider"].alias("provider"), r["board"].alias("board"), u.alias("url")
            ),
        ),
    )
    known = F.filter(routed, lambda b: b["provider"].isin("greenhouse", "lever", "workday"))

    def first_of_source(boards: Column) -> Column:
        return F.filter(
            boards, lambda b, i: ~F.exists(F.slice(boards, F.lit(1), i), lambda e: e["source"] == b["source"])
        )

    # Pages without any board host, nearly all of them, skip the link scan.
    mentions = page.rlike(r"(?i)myworkdayjobs\.com|greenhouse\.io|lever\.co")
    return F.when(mentions, let(known, first_of_source)).otherwise(F.array().cast(_BOARD))


def discover_job_links(pages: DataFrame, pattern: str = rules.JOB_LINK, limit: int = rules.LINKS_PER_PAGE) -> DataFrame:
    """``(page_id, pos, link)``; row-local, no shuffle."""
    links = job_links(F.col("html"), F.col("url"), pattern, limit)
    return unnest(pages, ["page_id"], links, "link", "pos")


def discover_boards(pages: DataFrame) -> DataFrame:
    """``(page_id, source, provider, board, board_url)``."""
    found = unnest(pages, ["page_id"], board_links(F.col("html"), F.col("url")), "b")
    return found.select("page_id", "b.source", "b.provider", "b.board", F.col("b.url").alias("board_url"))


def page_index(pages: DataFrame) -> DataFrame:
    """``url, page_id, is_html`` of the landed pages that were answered, one row per URL; no markup is read."""
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    answered = pages.where((F.coalesce(status, F.lit(200)) < 400) & F.col("page_id").isNotNull())
    rows = answered.select("url", "page_id", F.coalesce(kind.contains("html"), F.lit(True)).alias("is_html"))
    return distinct_first(rows, ["url"], "page_id")


def outline_columns(pattern: str = rules.JOB_LINK, limit: int = rules.LINKS_PER_PAGE) -> list[Column]:
    """What a crawl needs to know of a page, without its markup: postings, boards and links."""
    scripts = F.filter(H.json_ld(F.col("html")), lambda s: s.contains("JobPosting"))
    postings = F.exists(scripts, lambda s: F.exists(J.objects(s), J.is_posting))
    likely = F.col("html").contains("ld+json") & F.col("html").contains("JobPosting")
    return [
        F.col("page_id"),
        F.when(likely, F.coalesce(postings, F.lit(False))).otherwise(False).alias("has_postings"),
        board_links(F.col("html"), F.col("url")).alias("boards"),
        job_links(F.col("html"), F.col("url"), pattern, limit).alias("links"),
    ]


def page_role(depth: Column, has_postings: Column, new_links: Column, boards_so_far: Column,
              max_depth: int = rules.CRAWL_DEPTH) -> Column:
    """``postings``, ``listing``, ``deep_listing`` (too deep to follow), ``page`` or ``boards``.

    The start page of a site counts as a listing with a single new link, other pages from three on.
    """
    listing = (new_links >= rules.LISTING_LINKS) | ((depth == 0) & (new_links > 0))
    return (
        F.when(has_postings, "postings")
        .when(listing & (depth < max_depth), "listing")
        .when(listing, "deep_listing")
        .when((depth > 0) | ~boards_so_far, "page")
        .otherwise("boards")
    )


def crawl(pages: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, agent: str = "postlode",
          max_depth: int = rules.CRAWL_DEPTH, max_pages: int = rules.CRAWL_PAGES, pattern: str = rules.JOB_LINK,
          limit: int = rules.LINKS_PER_PAGE) -> DataFrame:
    """Pages a breadth-first crawl of each site reads, in visiting order.

    ``seeds`` has ``site, url, pos``.  Returns ``site, depth, rank, url, role, boards`` for the pages read: those
    present in ``pages``, permitted by ``robots`` and within ``max_pages`` per site.  Blocked and missing pages do
    not use up the budget; pages that are not HTML do, and have no role.

    One round per depth.  A round looks its URLs up in a narrow index of the landed pages, spends the budget, and only
    then reads markup: that of the pages it visits, each once however many sites ask for it.  A site brings at most
    ``max_pages * limit`` links into a round, so the per-site windows stay small.
    """
    J.let_last_key_win(pages.sparkSession)
    index = cut(page_index(pages), "page-index")
    # Built once: the rounds differ in the pages they read, not in what they read of them.
    outline = outline_columns(pattern, limit)
    frontier = seeds.select("site", "url", F.lit(0).alias("parent_rank"), F.col("pos"))
    levels: list[DataFrame] = []
    roles: list[DataFrame] = []
    in_order = Window.partitionBy("site").orderBy("parent_rank", "pos")
    for depth in range(max_depth + 1):
        seen = reduce(DataFrame.unionByName, levels) if levels else None
        queue = distinct_first(frontier, ["site", "url"], ["parent_rank", "pos"])
        if seen is not None:
            queue = queue.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        if robots is not None:
            queue = robots_verdicts(queue, robots, agent)
        else:
            queue = queue.withColumn("allowed", F.lit(True))
        # A round's queue is small beside the index.  Stored, its size is known, so Spark can send it to the
        # index instead of moving the index; only the pages asked for come back.
        queue = cut(queue, "crawl-queue")
        asked = index.join(queue.select("url").distinct(), "url", "left_semi")
        found = queue.join(asked, "url", "left")
        read = F.col("allowed") & F.col("is_html").isNotNull()
        found = found.withColumns({
            "rank": F.row_number().over(in_order),
            "fetched": read,
            "before": F.coalesce(F.sum(read.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        })
        if seen is not None:
            used = seen.groupBy("site").agg(F.sum(F.col("fetched").cast("int")).alias("used"))
            found = found.join(used, "site", "left")
        else:
            found = found.withColumn("used", F.lit(0))
        popped = found.where(F.coalesce("used", F.lit(0)) + F.col("before") < max_pages)
        popped = cut(
            popped.select("site", F.lit(depth).alias("depth"), "rank", "url", "page_id", "fetched", "is_html"), "crawl-popped"
        )
        wanted = popped.where("fetched AND is_html").select("page_id").distinct()
        read = pages.join(wanted, "page_id", "left_semi").select(*outline)
        level = cut(popped.join(read, "page_id", "left").drop("page_id"), "crawl-level")
        levels.append(level)
        visited = reduce(DataFrame.unionByName, levels).select(
            "site", F.col("url").alias("link"), F.struct("depth", "rank").alias("visited_at")
        )
        # A link is new to a page unless it was visited before that page or is the page itself.
        here = level.where("fetched AND is_html AND NOT has_postings").select(
            "site", "depth", "rank", F.posexplode("links").alias("pos", "link")
        )
        new = here.join(visited, ["site", "link"], "left").where(
            F.col("visited_at").isNull() | (F.col("visited_at") > F.struct("depth", "rank"))
        ).select("site", "rank", "pos", "link")
        counted = new.groupBy("site", "rank").agg(F.count("*").alias("new_links"))
        shows_board = F.col("is_html") & ~F.col("has_postings") & (F.size("boards") > 0)
        so_far = Window.partitionBy("site").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        boards_so_far = F.max(shows_board).over(so_far) if depth == 0 else F.lit(False)
        judged = level.where("fetched").join(counted, ["site", "rank"], "left").withColumn("_boards", boards_so_far)
        role = F.when(
            F.col("is_html"),
            page_role(F.col("depth"), F.col("has_postings"), F.coalesce("new_links", F.lit(0)), F.col("_boards"), max_depth),
        )
        boards = F.when(shows_board & (F.col("depth") == 0), F.col("boards")).otherwise(F.array().cast(_BOARD))
        judged = cut(
            judged.select("site", "depth", "rank", "url", role.alias("role"), boards.alias("boards")), "crawl-roles"
        )
        roles.append(judged)
        listings = judged.where("role = 'listing'").select("site", "rank")
        frontier = new.join(listings, ["site", "rank"], "left_semi").select(
            "site", F.col("link").alias("url"), F.col("rank").alias("parent_rank"), "pos"
        )
    return reduce(DataFrame.unionByName, roles)


def crawl_boards(visits: DataFrame) -> DataFrame:
    """Boards found on the start pages of each site, each once, with the place of its first mention."""
    rows = visits.select("site", "depth", "rank", F.posexplode("boards").alias("pos", "b"))
    rows = rows.select("site", "depth", "rank", "pos", "b.source", "b.provider", "b.board")
    return distinct_first(rows, ["site", "source"], ["depth", "rank", "pos"])


def board_places(visits: DataFrame) -> DataFrame:
    """Where a crawl ran into each board: ``site, page_no, board_no`` beside ``source, provider, board``."""
    page_no = page_number(F.col("depth"), F.col("rank"))
    return crawl_boards(visits).select("site", page_no.alias("page_no"), F.col("pos").alias("board_no"), "source", "provider", "board")


def board_payloads(visits: DataFrame, raw: DataFrame) -> DataFrame:
    """Landed payloads of the boards a crawl ran into, detail documents included."""
    wanted = crawl_boards(visits).select("provider", "board").distinct()
    details = wanted.where("provider = 'workday'").select(F.lit("workday_detail").alias("provider"), "board")
    # Stored for its size: a short board list is sent to the payloads, which then stay where they are.
    return raw.join(cut(wanted.unionByName(details), "boards"), ["provider", "board"], "left_semi")


def page_number(depth: Column, rank: Column) -> Column:
    """The place of a visited page within its site's crawl; a round visits far fewer than a billion pages of one site."""
    return depth * F.lit(1_000_000_000).cast("bigint") + rank


def crawl_postings(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """Postings on the crawled pages: structured data where present, else the page itself."""
    order = page_number(F.col("depth"), F.col("rank"))
    wanted = visits.where("role IN ('postings', 'page')").select("site", "url", "role", order.alias("page_no"))
    landed = pages.select("url", "page_id").join(wanted.select("url").distinct(), "url", "left_semi")
    # Stored for its size: the list of chosen pages goes to the markup if it is short enough.
    chosen = cut(wanted.join(distinct_first(landed, ["url"], "page_id"), "url"), "chosen-pages")
    rows = pages.drop("url").join(chosen, "page_id")
    structured = normalize_jsonld(rows.where("role = 'postings'").drop("role"))
    plain = normalize_html_page(rows.where("role = 'page'").drop("role"))
    return structured.unionByName(plain)


def seeds_for(sites: DataFrame, name: str | None = None) -> DataFrame:
    """Seed rows of a list of sites or URLs (column ``value``): crawled sites with their start URLs."""
    routed = sites.select(U.route(F.col("value")).alias("r")).where("r.provider = 'site'").distinct()
    source = F.lit(name) if name else F.col("r.source")
    return routed.select(source.alias("site"), F.posexplode("r.start_urls").alias("pos", "url")).select("site", "url", "pos")


def site_preset(spark, name: str) -> DataFrame:
    """Seed rows of a named site with fixed start URLs."""
    rows = [(name, url, i) for i, url in enumerate(rules.SITE_PRESETS[name])]
    return spark.createDataFrame(rows, "site STRING, url STRING, pos INT")
