"""A search over an ordered list of sites: hosted boards, named sources and crawled career pages in one run.

Every posting has a place: the site's position in the list, the page of that site's crawl, the board that page links to,
and the request and item within the board's payloads.  A board found on a start page stands before whatever the crawl
reads after that page, and the whole site before the next one in the list.  Places are structs, so that they order
postings across all sources without numbering them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .. import rules
from ..functions import urls as U
from ..functions.core import text_or_empty, trim_ws
from ..operators.crawl import board_places, crawl, crawl_postings
from ..operators.distinct import distinct_first
from ..session import cut
from ..sources.raw import split_broken
from ..sources.registry import normalize, providers_in
from ..sources.web import linkedin_landed, normalize_linkedin
from .search import SearchSpec, search_postings

# The order of postings: site in the list, page of its crawl, board on that page (-1: the page itself), request and item.
PLACE = {"site_pos": "bigint", "page_no": "bigint", "board_no": "int", "request_no": "bigint", "item_pos": "int"}
_DETAIL = "_detail"
# Requests of a board lie between these; a missing number counts as the first.
_FIRST, _NO_END = -(1 << 63), (1 << 63) - 1
# Places multiply the text of postings by so much at least before it is dealt out, in pieces of so many bytes: a task's share
# differs from that, and a Parquet dictionary ends at a megabyte.
SHARED, TEXT_BYTES = 4, 600_000


def route_sites(sites: DataFrame) -> DataFrame:
    """``site_pos, source, provider, board, start_urls`` of a list ``(pos, value)``, each source at its first mention.

    Blank entries are skipped; an entry that is no address of a site is an error before anything runs.
    """
    routed = cut(sites.select("pos", "value", U.route(F.col("value")).alias("r")).where(trim_ws(text_or_empty(F.col("value"))) != ""), "routes")
    wrong = routed.where("r IS NULL").orderBy("pos").select("value").first()
    if wrong is not None:
        raise ValueError(f"Not an address of a site: {wrong['value']!r}")
    rows = routed.select(F.col("pos").cast("bigint").alias("site_pos"), "r.source", "r.provider", "r.board", "r.start_urls")
    return cut(distinct_first(rows, ["source"], "site_pos"), "sites")


def _place(df: DataFrame, **parts: Column) -> DataFrame:
    """Replace ``seq`` by the place made of ``parts``; a part that is not given is 0."""
    place = F.struct(*[parts.get(name, F.lit(0)).cast(kind).alias(name) for name, kind in PLACE.items()])
    return df.withColumn("seq", place).drop("site_pos", "page_no", "board_no")


def lasting_places(places: DataFrame, failed: DataFrame) -> DataFrame:
    """``places`` with ``until``: a place counts for the requests before that one.  Places behind the failure of their site are left out."""
    here, end = F.struct("page_no", "board_no"), F.struct("failed_at.page_no", "failed_at.board_no")
    until = F.when(F.col("failed_at").isNull() | (here < end), F.lit(_NO_END)).when(
        here == end, F.coalesce("failed_at.request_no", F.lit(_FIRST)))
    return places.join(failed, "site_pos", "left").withColumn("until", until).where("until IS NOT NULL").drop("failed_at")


def first_places(lasting: DataFrame) -> DataFrame:
    """``source, since, until`` and the place where the requests ``since <= request_no < until`` of that source are met first.

    A source has one row for every request at which one of its sites failed on it, and one for all that goes on: a few
    rows, however many sites link to it.
    """
    at = F.struct("site_pos", "page_no", "board_no")
    firsts = lasting.groupBy("source", "until").agg(F.min(at).alias("at"))
    # Requests before a limit are also met at the places of all later limits.
    later = Window.partitionBy("source").orderBy(F.desc("until"))
    since = F.coalesce(F.lead("until").over(later), F.lit(_FIRST))
    return firsts.select("source", since.alias("since"), "until", F.min("at").over(later).alias("at")).select("source", "since", "until", "at.*")


def deal_texts(rows: DataFrame, held: int, placed: int) -> DataFrame:
    """``rows``, whose texts take ``held`` bytes and ``placed`` with all their places, dealt out for the copies to be stored once.

    A file of a columnar format keeps a text once, however many of its rows have it, as long as its texts fit a dictionary;
    past that it spells out every copy.  So where postings get many places, a task takes no more texts than a dictionary does.
    """
    if not held or placed < SHARED * held:
        return rows
    return rows.repartition(-(-held // TEXT_BYTES), "source", "seq", "url", "title")


def board_postings(raw: DataFrame, places: DataFrame, as_of: Column, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings of the landed payloads behind ``places``, and per site the first place where a payload was broken.

    ``places`` has ``site_pos, page_no, board_no, source, provider, board``.  Payloads are read and normalised once, however
    many sites link to their board; the places are joined to the postings, each up to where its site failed.  With ``once``,
    a posting with an address stands at the first place alone where no failure hides it.
    """
    listed = places.groupBy("provider", "board").agg(F.count("*").alias("_places"))
    details = listed.where("provider = 'workday'").select(F.concat("provider", F.lit(_DETAIL)).alias("provider"), "board", "_places")
    wanted = cut(listed.unionByName(details), "wanted-boards")
    landed = raw.withColumn("board", text_or_empty(F.col("board"))).join(wanted, ["provider", "board"])
    sizes, size = Observation(), F.octet_length("payload").cast("bigint")
    sized = landed.observe(sizes, F.sum(size).alias("held"), F.sum(size * F.col("_places")).alias("placed"))
    usable, lost = split_broken(landed, read=sized)
    # Kinds of provider that no site leads to need no reading.
    rows = normalize(usable.withColumn("source_rank", F.lit(0)), as_of, providers_in(wanted) or None)
    ended = F.col("fault").isin("unreadable", "kind") & ~F.col("provider").endswith(_DETAIL)
    first = lost.where(ended).groupBy("provider", "board").agg(F.min("request_no").alias("request_no"))
    at = F.struct("page_no", "board_no", F.col("request_no").cast("bigint").alias("request_no"))
    failed = places.join(first, ["provider", "board"]).groupBy("site_pos").agg(F.min(at).alias("failed_at"))
    # Stored for its size: there is one row per site that failed.
    failed = cut(failed, "failed-sites")
    where = ["site_pos", "page_no", "board_no"]
    lasting = cut(lasting_places(places, failed), "lasting-places")
    if once:
        every = lasting.select("source", *where, F.lit(_FIRST).alias("since"), "until", F.lit(False).alias("_addressed"))
        firsts = first_places(lasting).select("source", *where, "since", "until", F.lit(True).alias("_addressed"))
        placed = rows.withColumn("_addressed", U.url_key(F.col("url")).isNotNull()).join(cut(every.unionByName(firsts), "first-places"), ["source", "_addressed"])
    else:
        rows = deal_texts(rows, sizes.get["held"] or 0, sizes.get["placed"] or 0)
        placed = rows.join(lasting.select("source", *where, F.lit(_FIRST).alias("since"), "until"), "source")
    request_no = F.coalesce("seq.request_no", F.lit(_FIRST))
    placed = placed.where((request_no >= F.col("since")) & (request_no < F.col("until"))).drop("_addressed", "since", "until")
    postings = _place(
        placed, site_pos=F.col("site_pos"), page_no=F.col("page_no"), board_no=F.col("board_no"),
        request_no=F.col("seq.request_no"), item_pos=F.col("seq.item_pos"),
    )
    return postings, failed


def site_postings(pages: DataFrame, raw: DataFrame, robots: DataFrame | None, sites: DataFrame, spec: SearchSpec,
                  agent: str = "postlode", max_depth: int = rules.CRAWL_DEPTH, max_pages: int = rules.CRAWL_PAGES,
                  once: bool = False) -> DataFrame:
    """Postings of every site of the list, ``seq`` being their place.

    A broken payload ends its site there: what stands before it is kept, and other sites are not touched.

    A board's posting has as many places as sites that link to the board, so all places are sites times postings.  With
    ``once``, postings of boards that have an address come at their first place only, which is all that a removal of
    duplicates can keep of them; those without one still come at every place.
    """
    routes = route_sites(sites)
    crawled = routes.where("provider = 'site'")
    seeds = crawled.select(F.col("source").alias("site"), F.posexplode("start_urls").alias("pos", "url")).select("site", "url", "pos")
    visits = cut(crawl(pages, seeds, robots, agent, max_depth, max_pages), "visits")
    site_of = crawled.select(F.col("source").alias("site"), "site_pos")
    direct = routes.where("provider NOT IN ('site', 'linkedin')").select(
        "site_pos", F.lit(0).cast("bigint").alias("page_no"), F.lit(0).alias("board_no"), "source", "provider", "board")
    linked = board_places(visits).join(site_of, "site").select("site_pos", "page_no", "board_no", "source", "provider", "board")
    hosted, failed = board_postings(raw, cut(direct.unionByName(linked), "board-places"), spec.today, once)

    found = crawl_postings(pages, visits).join(crawled.select("source", "site_pos"), "source")
    out = _place(found, site_pos=F.col("site_pos"), page_no=F.col("seq.request_no"), board_no=F.lit(-1), item_pos=F.col("seq.item_pos"))

    linkedin = routes.where("provider = 'linkedin'").select("source", "site_pos")
    if not linkedin.isEmpty():
        cards = normalize_linkedin(*linkedin_landed(pages), remote_only=spec.remote_only, include_hybrid=spec.include_hybrid)
        out = out.unionByName(_place(
            cards.join(linkedin, "source"), site_pos=F.col("site_pos"), request_no=F.col("seq.request_no"), item_pos=F.col("seq.item_pos")))

    failed = failed.withColumnRenamed("site_pos", "_site")
    marked = out.join(failed, out["seq.site_pos"] == F.col("_site"), "left")
    before = F.struct("seq.page_no", "seq.board_no", "seq.request_no") < F.col("failed_at")
    return hosted.unionByName(marked.where(F.col("failed_at").isNull() | before).drop("_site", "failed_at"))


def search_sites(pages: DataFrame, raw: DataFrame, robots: DataFrame | None, sites: DataFrame, spec: SearchSpec,
                 agent: str = "postlode", max_depth: int = rules.CRAWL_DEPTH, max_pages: int = rules.CRAWL_PAGES) -> DataFrame:
    """Search the postings of a list of sites: dedupe in the order of their places, enrich, filter, limit, project."""
    return search_postings(site_postings(pages, raw, robots, sites, spec, agent, max_depth, max_pages, once=True), spec)
