"""Every operator of the library as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlode import rules
from postlode.functions import dates as D, html as H, text as X, urls as U
from postlode.functions.detect import (
    detect_certifications, detect_clearance, detect_education, detect_experience, detect_remote,
)
from postlode.operators import crawl as C, filters as P, robots as R
from postlode.operators.dedupe import dedupe_postings
from postlode.operators.distinct import distinct_first
from postlode.operators.enrich import enrich
from postlode.plans.sites import search_sites, site_postings
from postlode.plans.search import SearchSpec, filtered_postings, first_matches, postings_filter, search_postings
from postlode.session import shared_dir
from postlode.sinks.write import cap_cells, infer_format, read_postings, to_sheet_rows, write_postings
from postlode.sources import boards as B, raw as L, registry as G, web as W
from postlode.sources.postings import as_postings, sequence_of, union_sources
from postlode.streaming.ingest import stream_postings

from .views import AS_OF, BOARD_SITE_PAGES, BROKEN_BOARD, BROKEN_FROM, FAULTY, FIRST_SITE, FIXED_SITES, MANY_SITE_PAGES, POSTINGS, SITE_PAGES

SPEC = dict(as_of=date.fromisoformat(AS_OF))
PAGE_LINKS = r"/[A-Za-z]"


def today() -> Column:
    return F.lit(AS_OF).cast("date")


def board_name() -> Column:
    return F.concat(F.lit("board"), (F.floor(F.col("posting_id") / 10) % 4).cast("string"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, name: str) -> DataFrame:
    table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def posting_view(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, POSTINGS, "documents")


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, SITE_PAGES, "pages")


def many_site_pages(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, MANY_SITE_PAGES, "pages")


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The posting view in the canonical shape, still carrying its numeric ``seq``."""
    v = posting_view(spark, sf)
    named = {c: F.col(c) for c in ("title", "company", "location", "source", "url", "tags", "description")}
    return as_postings(v, F.col("seq"), posted_date=F.col("posted_raw"), **named)


def joined(*names: str, sep: str = "|") -> list[Column]:
    return [F.array_join(n, sep).alias(n) for n in names]


# ---------------------------------------------------------------- filters


def _where(condition: Callable[[], Column]):
    return lambda spark, sf: posting_view(spark, sf).where(condition()).select("posting_id", "title")


def remote_class(spark, sf):
    return posting_view(spark, sf).select(
        "posting_id", detect_remote(F.col("title"), F.col("location"), F.col("description"), F.col("tags")).alias("remote")
    )


def remote_filter(spark, sf):
    return remote_class(spark, sf).where(P.remote_pred(include_hybrid=True))


def posted_parse(spark, sf):
    day = D.parse_date(F.col("posted_raw"), today())
    return posting_view(spark, sf).select(
        "posting_id", F.date_format(day, "yyyy-MM-dd").alias("posted_on"),
        D.normalize_date(F.col("posted_raw"), today()).alias("posted_date"),
    )


def domain_table(spark, sf):
    """Domains come from a table: each supplier of the first region's nations stands for one listed domain."""
    listed = table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") == 0, "https://www.Example.com/").when(F.col("r_regionkey") == 1, "other.test.")
        .otherwise(F.concat(F.lower("r_name"), F.lit(".test"))).alias("domain")
    )
    return P.domain_table_filter(posting_view(spark, sf), listed).select("posting_id", "url")


TERMS = ["part-time", "VPN", "Security+", "B.S.", "TS/SCI", "full  time", "help desk lead", "remote - us", "+", "degree"]


def term_table(spark, sf):
    terms = G.field_terms_table(spark).select("term").unionByName(spark.createDataFrame([(t,) for t in TERMS], "term STRING"))
    return P.term_matches(posting_view(spark, sf), terms.distinct(), P.search_text())


# ---------------------------------------------------------------- text mining


def _mined(name: str, value: Callable[[Column], Column]):
    return lambda spark, sf: posting_view(spark, sf).select("posting_id", value(F.col("description")).alias(name))


def enriched(spark, sf):
    out = enrich(canonical(spark, sf), today())
    return out.select(
        "seq", "title", "remote", "posted_date", "education", "experience", *joined("certifications", "clearance", "requirements")
    )


# ---------------------------------------------------------------- distinct, dedupe, search


def distinct_hosts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"))
    return distinct_first(pages, ["host"], "page_id").select("host", "page_id", "url")


def dedupe(spark, sf):
    return dedupe_postings(posting_view(spark, sf)).select("posting_id", "title", "company", "source", "url")


def limited(spark, sf):
    found = posting_view(spark, sf).where(P.match_any(P.search_text(), ["security"]))
    return first_matches(found, 50).select("posting_id", "title")


def search_spec(**kw) -> SearchSpec:
    return SearchSpec(
        **SPEC, fields=["cybersecurity"], keywords=["help desk"], exclude=["senior"], remote_only=True,
        include_hybrid=True, posted_within_days=14, include_undated=True, exclude_domains=["other.test"], **kw,
    )


def search(spark, sf):
    out = search_postings(canonical(spark, sf), search_spec())
    return out.select("title", "company", "remote", "url", "source", "posted_date", "education", "experience",
                      *joined("certifications", "clearance"))


def filtered(spark, sf):
    """The whole predicate of a search on enriched postings, without duplicate removal."""
    out = enrich(canonical(spark, sf), today()).where(postings_filter(search_spec()))
    return out.select("seq", "title", "remote", "posted_date")


def _payload_runs(spark, sf) -> DataFrame:
    """Payloads as three runs land them: each third of the requests holds those of every board.  One board breaks in the second run."""
    item = F.struct(
        "title", F.col("url").alias("absolute_url"), F.col("company").alias("company_name"), F.struct(F.col("location").alias("name")).alias("location"),
        F.date_format(F.date_add(today(), -(F.col("posting_id") % 30).cast("int")), "yyyy-MM-dd").alias("first_published"),
        F.transform("tags", lambda t: F.struct(t.alias("name"))).alias("departments"), H.html_escape(_markup(F.col("description"))).alias("content"))
    raw = _payloads(spark, sf, "greenhouse", item, lambda x: F.concat(F.lit('{"jobs":['), x, F.lit("]}")), F.col("source"))
    last = raw.agg(F.max("request_no")).first()[0]
    raw = raw.withColumn("run", F.least(F.floor(F.col("request_no") * 3 / (last + 1)), F.lit(2)).cast("int"))
    torn = F.col("payload").substr(F.lit(1), F.length("payload") - 9)
    bad = (F.col("board") == "s1") & (F.col("run") == 1) & (F.col("request_no") % 2 == 1)
    return raw.withColumn("payload", F.when(bad, torn).otherwise(F.col("payload"))).withColumn("fetched_at", F.lit(None).cast("timestamp"))


def _streamed(spark, sf) -> str:
    """Three runs over payload files, several files a run; the folder that holds what came out."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = _payload_runs(spark, sf)
    # A file for every core, so that a run is written and read by all of them.
    files = max(4, spark.sparkContext.defaultParallelism)
    for run in range(3):
        raw.where(F.col("run") == run).drop("run").repartition(files).write.mode("append").parquet(f"{base}/in")
        source = L.read_raw(spark, f"{base}/in", streaming=True)
        stream_postings(source, search_spec(), f"{base}/out", f"{base}/state", f"{base}/checkpoint", quarantine=f"{base}/lost").awaitTermination()
    return base


def stream(spark, sf):
    """What a search finds in payload files that arrive in three runs, with all that is mined from the texts."""
    out = spark.read.parquet(_streamed(spark, sf) + "/out")
    return out.select("title", "company", "location", "remote", "url", "source", "posted_date", "summary", "education", "experience",
                      *joined("tags", "certifications", "clearance", "requirements"))


def stream_quarantine(spark, sf):
    """The payloads that those runs set aside."""
    lost = spark.read.parquet(_streamed(spark, sf) + "/lost")
    return lost.select("board", F.col("request_no").cast("bigint").alias("request_no"), "fault")


# ---------------------------------------------------------------- providers: payloads are built from the postings


def _markup(text: Column) -> Column:
    return F.concat(F.lit("<p>"), H.html_escape(text), F.lit("</p><script>x</script><ul><li>One</li><li>Two &amp; three</li></ul>"))


def _payloads(spark, sf, provider: str, item: Column, wrap: Callable[[Column], Column], board: Column | None = None) -> DataFrame:
    """Ten postings per request, as JSON text."""
    v = posting_view(spark, sf)
    rows = v.select(
        F.floor(F.col("posting_id") / 10).cast("int").alias("request_no"),
        (F.lit("") if board is None else board).alias("board"), "posting_id", F.to_json(item).alias("item"),
    )
    packed = rows.groupBy("board", "request_no").agg(F.array_sort(F.collect_list(F.struct("posting_id", "item"))).alias("items"))
    listed = F.array_join(F.transform("items", lambda i: i["item"]), ",")
    return packed.select(
        F.lit(provider).alias("provider"), "board", "request_no", F.lit("").alias("url"), wrap(listed).alias("payload")
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.select("title", "company", "location", "remote", "url", "source", "posted_date", "employment_type",
                     "salary", *joined("tags"), "description")


def remoteok(spark, sf):
    item = F.struct(
        F.col("posting_id").alias("id"),
        F.when(F.col("posting_id") % 17 != 0, F.col("title")).alias("position"), "company", "location",
        F.when(F.col("posting_id") % 3 != 0, F.col("url")).alias("url"),
        F.lit("2026-10-01T00:00:00+00:00").alias("date"),
        (F.col("posting_id") % 5 * 1000).alias("salary_min"), (F.col("posting_id") % 7 * 25000).alias("salary_max"),
        "tags", _markup(F.col("description")).alias("description"),
    )
    raw = _payloads(spark, sf, "remoteok", item, lambda x: F.concat(F.lit('[{"legal":"terms"},"note",'), x, F.lit("]")))
    return _shown(B.normalize_remoteok(raw))


def remotive(spark, sf):
    item = F.struct(
        "title", F.col("company").alias("company_name"), "url",
        F.when(F.col("posting_id") % 4 != 0, F.lit("Security")).alias("category"),
        F.when(F.col("posting_id") % 2 == 0, "full_time").otherwise("part-time_contract").alias("job_type"),
        F.col("location").alias("candidate_required_location"), F.lit("2026-09-30T08:00:00").alias("publication_date"),
        F.lit("90k").alias("salary"), "tags", _markup(F.col("description")).alias("description"),
    )
    raw = _payloads(spark, sf, "remotive", item, lambda x: F.concat(F.lit('{"jobs":['), x, F.lit("]}")))
    return _shown(B.normalize_remotive(raw))


def arbeitnow(spark, sf):
    item = F.struct(
        "title", F.col("company").alias("company_name"), "location", "url",
        (F.col("posting_id") % 2 == 0).alias("remote"), (1790000000 + F.col("posting_id") * 3600).alias("created_at"),
        F.array(F.lit("full time"), F.lit("permanent")).alias("job_types"), "tags",
        _markup(F.col("description")).alias("description"),
    )
    raw = _payloads(spark, sf, "arbeitnow", item, lambda x: x)
    # The first two requests say there is a next page, the others don't: landed by two runs, all of them are read.
    pages = raw.select(
        "provider", "board", "url",
        F.when(F.col("request_no") % 3 < 2, F.col("request_no") % 2).otherwise(F.lit(2) + F.col("request_no") % 2).alias("request_no"),
        F.concat(F.lit('{"data":['), "payload", F.lit('],"links":'),
                 F.when(F.col("request_no") % 3 < 2, '{"next":"more"}').otherwise("null"), F.lit("}")).alias("payload"),
    )
    return _shown(B.normalize_arbeitnow(pages))


def greenhouse(spark, sf):
    item = F.struct(
        "title", F.col("url").alias("absolute_url"),
        F.when(F.col("posting_id") % 2 == 0, F.col("company")).alias("company_name"),
        F.struct(F.col("location").alias("name")).alias("location"),
        F.when(F.col("posting_id") % 3 == 0, F.lit("2026-09-29T10:00:00-04:00")).alias("first_published"),
        F.lit("2026-09-30T10:00:00-04:00").alias("updated_at"),
        F.array(F.struct(F.lit("Security").alias("name")), F.struct(F.lit("").alias("name"))).alias("departments"),
        H.html_escape(_markup(F.col("description"))).alias("content"),
    )
    raw = _payloads(spark, sf, "greenhouse", item, lambda x: F.concat(F.lit('{"jobs":['), x, F.lit("]}")), board_name())
    return _shown(B.normalize_greenhouse(raw))


def lever(spark, sf):
    item = F.struct(
        F.col("title").alias("text"), F.col("url").alias("hostedUrl"),
        F.when(F.col("posting_id") % 3 == 0, "Hybrid").when(F.col("posting_id") % 3 == 1, "on-site").alias("workplaceType"),
        F.struct("location", F.lit("Full-time").alias("commitment"), F.lit("Blue").alias("team"),
                 F.when(F.col("posting_id") % 2 == 0, F.lit("Ops")).alias("department")).alias("categories"),
        (F.lit(1790000000000) + F.col("posting_id") * 86400000).alias("createdAt"),
        _markup(F.col("description")).alias("description"),
        F.array(F.struct(F.lit("Tools & more").alias("text"), F.lit("<li>OSCP</li><li>Go</li>").alias("content"))).alias("lists"),
        F.lit("<div>End</div>").alias("additional"),
        F.struct(F.lit(90000).alias("min"), (90000 + F.col("posting_id") % 3 * 500).alias("max"), F.lit("USD").alias("currency"),
                 F.lit("per-year-salary").alias("interval")).alias("salaryRange"),
    )
    raw = _payloads(spark, sf, "lever", item, lambda x: F.concat(F.lit("["), x, F.lit("]")), board_name())
    return _shown(B.normalize_lever(raw))


def _workday_raw(spark, sf) -> DataFrame:
    v = posting_view(spark, sf)
    path = F.concat(F.lit("/job/J"), F.floor(F.col("posting_id") / 2).cast("string"))
    board = F.concat(F.lit("acme"), (F.floor(F.col("posting_id") / 500)).cast("string"), F.lit(".wd5.myworkdayjobs.com/External"))
    item = F.struct(
        "title", F.when(F.col("posting_id") % 19 != 0, path).alias("externalPath"), F.col("location").alias("locationsText"),
        F.col("posted_raw").alias("postedOn"), F.lit("On site").alias("remoteType"),
        F.array(F.concat(F.lit("R"), F.col("posting_id").cast("string"))).alias("bulletFields"),
    )
    rows = v.select("posting_id", board.alias("board"), F.to_json(item).alias("item"))
    packed = rows.withColumn("request_no", F.floor(F.col("posting_id") % 500 / 20).cast("int")).groupBy("board", "request_no").agg(
        F.array_sort(F.collect_list(F.struct("posting_id", "item"))).alias("items"))
    listing = packed.select(
        F.lit("workday").alias("provider"), "board", "request_no", F.lit("").alias("url"),
        F.concat(F.lit('{"total":500,"jobPostings":['), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]}")).alias("payload"),
    )
    detail = F.struct(
        F.struct(
            F.concat(F.col("title"), F.lit(" (detail)")).alias("title"), F.lit("Remote - USA").alias("location"),
            F.array(F.lit("Austin, TX"), F.lit("")).alias("additionalLocations"), F.lit("Fully Remote").alias("remoteType"),
            F.lit("Full time").alias("timeType"),
            F.when(F.col("posting_id") % 4 == 0, "2026-10-01").otherwise("2999-01-01").alias("startDate"),
            _markup(F.col("description")).alias("jobDescription"),
        ).alias("jobPostingInfo"),
        F.struct(F.col("company").alias("name")).alias("hiringOrganization"),
    )
    host = F.split_part("board", F.lit("/"), F.lit(1))
    details = v.where("posting_id % 2 = 0 AND posting_id % 6 <> 0").withColumn("board", board).select(
        F.lit("workday_detail").alias("provider"), "board", F.lit(0).alias("request_no"),
        F.concat(F.lit("https://"), host, F.lit("/wday/cxs/acme/External"), path).alias("url"), F.to_json(detail).alias("payload"),
    )
    return listing.unionByName(details)


def workday(spark, sf):
    return _shown(B.normalize_workday(_workday_raw(spark, sf), today()))


def select_by_name(spark, sf):
    """Payload rows of chosen sources, ranked in the order they were named."""
    raw = posting_view(spark, sf).select(
        F.element_at(F.array(*[F.lit(n) for n, _, _ in rules.SOURCES] + [F.lit("greenhouse")]), (F.col("posting_id") % 6 + 1).cast("int")).alias("provider"),
        board_name().alias("board"), "posting_id",
    )
    chosen = G.select_sources(raw, ["https://www.remotive.com", "remoteok", "remotive"], {"greenhouse": ["board1"]})
    return chosen.select("posting_id", "provider", "board", F.col("source_rank").cast("bigint").alias("source_rank"))


def sources_union(spark, sf):
    v = canonical(spark, sf).withColumn("seq", sequence_of(F.lit(0), F.lit(""), F.col("seq"), F.lit(0)))
    parts = [v.where(F.col("source") == s) for s in ("s2", "s0", "s1")]
    out = union_sources(parts)
    return out.select(
        F.col("seq.source_rank").cast("bigint").alias("source_rank"), F.col("seq.request_no").alias("request_no"), "source", "title"
    )


def _landed(spark, sf) -> DataFrame:
    """Payload rows of which some are broken JSON."""
    v = posting_view(spark, sf)
    return v.select(
        F.col("source").alias("provider"), board_name().alias("board"), F.col("posting_id").cast("int").alias("request_no"), "url",
        F.when((F.col("posting_id") % 10 == 7) & (F.col("posting_id") > 60), F.concat(F.lit("{bad "), "title"))
        .otherwise(F.to_json(F.struct("title"))).alias("payload"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def quarantine(spark, sf):
    usable, lost = L.split_broken(_landed(spark, sf))
    return usable.select("request_no", F.lit("usable").alias("state")).unionByName(lost.select("request_no", F.lit("lost").alias("state")))


def quarantine_faults(spark, sf):
    """Payloads of every provider that are no JSON, of the wrong kind, or an error message in place of an answer."""
    v = posting_view(spark, sf)
    kinds = F.array(*[F.lit(k) for k in FAULTY])
    provider = F.element_at(kinds, (F.col("posting_id") % len(FAULTY) + 1).cast("int"))
    body = F.array(F.struct(F.col("description").alias("text")))
    good = F.when(provider.isin("lever", "remoteok"), F.to_json(body)).when(provider == "arbeitnow", F.to_json(F.struct(body.alias("data")))) \
        .otherwise(F.to_json(F.struct(body.alias("jobs"))))
    nth = F.floor(F.col("posting_id") / len(FAULTY))
    payload = F.when(nth % 9 == 4, F.to_json(F.struct(F.col("title").alias("error")))).when(nth % 50 == 39, F.lit('"down"')).when(nth % 70 == 69, F.lit("{")).otherwise(good)
    raw = v.select(provider.alias("provider"), board_name().alias("board"), F.col("posting_id").cast("int").alias("request_no"), "url", payload.alias("payload"), F.lit(None).cast("timestamp").alias("fetched_at"))
    usable, lost = L.split_broken(raw)
    return usable.select("provider", "board", "request_no", F.lit("").alias("fault")).unionByName(lost.select("provider", "board", "request_no", "fault"))


# ---------------------------------------------------------------- pages


def jsonld(spark, sf):
    v = posting_view(spark, sf)
    even = F.col("posting_id") % 2 == 0
    posting = F.to_json(F.struct(
        F.when(even, F.lit("JobPosting")).otherwise(F.lit("X")).alias("@type"), F.concat(F.lit("[New] "), "title", F.lit(" &amp; Co")).alias("title"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.array(
            F.struct(F.struct(F.lit("Reston").alias("addressLocality"), F.lit("VA").alias("addressRegion"),
                              F.struct(F.lit("US").alias("name")).alias("addressCountry")).alias("address")),
            F.struct(F.struct(F.col("location").alias("addressLocality"), F.lit(None).cast("string").alias("addressRegion"),
                              F.struct(F.lit(None).cast("string").alias("name")).alias("addressCountry")).alias("address")),
        ).alias("jobLocation"),
        F.when(F.col("posting_id") % 3 == 0, "telecommute").alias("jobLocationType"),
        F.when(F.col("posting_id") % 5 == 0, "/apply/1#x").alias("url"), F.lit("2026-09-01T00:00").alias("datePosted"),
        F.array(F.lit("FULL_TIME"), F.lit("CONTRACTOR")).alias("employmentType"),
        F.struct(F.lit("USD").alias("currency"),
                 F.struct(F.lit(80000).alias("minValue"), F.lit(95000).alias("maxValue"), F.lit("YEAR").alias("unitText")).alias("value")).alias("baseSalary"),
        F.lit("IT").alias("industry"),
        F.struct(F.when(F.col("posting_id") % 3 == 0, "bachelor degree").otherwise("none").alias("credentialCategory")).alias("educationRequirements"),
        F.struct(F.when(F.col("posting_id") % 4 < 2, F.col("posting_id") % 4 * 30 + 36).alias("monthsOfExperience"),
                 F.lit("5 years of work experience").alias("description")).alias("experienceRequirements"),
        F.lit("<ul><li>CISSP</li><li>Go</li></ul>").alias("skills"), _markup(F.col("description")).alias("description"),
    ))
    posting = F.replace(posting, F.lit("</"), F.lit("<\\/"))
    html = F.concat(
        F.lit('<html><head><!-- <script type="application/ld+json">{"@type":"JobPosting","title":"hidden"}</script> -->'
              '<script type="application/ld+json">{bad JobPosting</script><script type=\'application/ld+json\'>'),
        F.when(F.col("posting_id") % 4 < 2, F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), posting, F.lit("]}")))
        .otherwise(F.concat(F.lit("[["), posting, F.lit("]]"))),
        F.lit("</script></head><body>x</body></html>"),
    )
    pages = v.select(F.col("posting_id").alias("page_id"), F.concat(F.lit("https://www.Careers.test/p/"), F.col("posting_id").cast("string"), F.lit("#f")).alias("url"), html.alias("html"))
    out = W.normalize_jsonld(pages)
    return out.select("title", "company", "location", "remote", "url", "source", "posted_date", "employment_type", "salary",
                      *joined("tags", "requirements"), "education", "experience", "description")


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))


def page_links(spark, sf):
    found = C.discover_job_links(table(spark, sf, "pages"), PAGE_LINKS)
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


def html_pages(spark, sf):
    out = W.normalize_html_page(table(spark, sf, "pages"))
    return out.select(F.col("seq.request_no").alias("page_id"), "title", "company", "url", "source", "posted_date", "description")


def page_titles(spark, sf):
    """Titles with a site name and a company put on every page."""
    p = table(spark, sf, "pages")
    title = F.concat(
        F.lit("Engineer "), F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 3 == 0, " : Acme").when(F.col("page_id") % 3 == 1, " at Beta Corp").otherwise(""),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" | "), F.split_part(U.bare_host(F.col("url")), F.lit("."), F.lit(1)))).otherwise(" - My Site"),
    )
    return p.select("page_id", W.split_title(title, F.lit("My site"), F.col("url")).alias("t")).select("page_id", "t.title", "t.company")


def _board_refs() -> Column:
    p = F.col("page_id").cast("string")
    return F.concat(
        "html", F.lit('<a href="https://boards.greenhouse.io/acme'), p, F.lit('">Jobs</a><a href="https://boards.greenhouse.io/acme'), p,
        F.lit('/jobs/1">x</a><script>var u="https://jobs.lever.co/no";</script><iframe src="https://Acme.wd1.myworkdayjobs.com/en-US/Careers'),
        (F.col("page_id") % 3).cast("string"), F.lit('"></iframe><a href="https://lever.co">no</a><!-- <a href="https://jobs.lever.co/hidden"> -->'
        '<script src="//jobs.lever.co/beta/9?x=1"></script><a href="https://evil-lever.co/x">e</a>'),
    )


def boards_found(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", _board_refs())
    return C.discover_boards(pages)


def routes(spark, sf):
    p = F.col("page_id").cast("string")
    forms = [
        F.concat(F.lit("tenant"), p, F.lit(".wd3.myworkdayjobs.com/de-DE/Site/job/1")), F.concat(F.lit("https://boards.greenhouse.io/embed/job_board/js?x=1&for=co"), p),
        F.concat(F.lit("https://jobs.lever.co/co"), p, F.lit("/1")), F.lit(" www.remotive.com "), F.lit("ninjajobs.org"), F.col("url"),
        F.concat(F.lit("Site"), p, F.lit(".Example.com")), F.lit("https://de.linkedin.com/jobs"), F.lit("ftp://x.test/"), F.lit("https://notgreenhouse.io/acme"),
    ]
    site = F.element_at(F.array(*forms), (F.col("page_id") % 10 + 1).cast("int"))
    r = table(spark, sf, "pages").select("page_id", U.route(site).alias("r"))
    return r.select("page_id", "r.provider", "r.board", "r.source", F.array_join("r.start_urls", " ").alias("start_urls"))


def robots_table(spark, sf) -> DataFrame:
    origins = site_pages(spark, sf).groupBy("origin").agg(F.min("page_id").alias("p"))
    body = (
        F.when(F.col("p") % 3 == 0, "User-agent: *\nDisallow: /jobs/1 # old\nAllow: /\n\nUser-agent: PostLode\nDisallow: /jobs/2\nAllow: /jobs/3\nDisallow: /jobs/3")
        .when(F.col("p") % 3 == 1, "User-agent: other\nUser-agent: *\nCrawl-delay: 5\nAllow: /jobs/11\nDisallow: /jobs/1%31\nDisallow: /jobs/1")
        .otherwise("User-agent: nobody\nDisallow: /\n\n# end")
    )
    return origins.select("origin", F.when(F.col("p") == 4, 403).when(F.col("p") == 5, 404).otherwise(200).alias("status"), body.alias("body"))


def robots(spark, sf):
    return R.robots_filter(site_pages(spark, sf), robots_table(spark, sf), "postlode/1.0 (test)").select("page_id", "url")


def site_seeds(spark, sf) -> DataFrame:
    """Two start pages per site: the lowest page and a page that is not there."""
    first = site_pages(spark, sf).groupBy("origin").agg(F.min("page_id").alias("p"))
    urls = F.array(F.concat("origin", F.lit("/jobs/none")), F.concat("origin", F.lit("/jobs/"), F.col("p").cast("string")))
    return first.select(F.col("origin").alias("site"), F.posexplode(urls).alias("pos", "url")).select("site", "url", "pos")


def crawl_reachable(spark, sf):
    visits = C.crawl(site_pages(spark, sf), site_seeds(spark, sf), max_pages=8)
    return visits.select("site", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"), "url", "role")


def crawl_found(spark, sf):
    """Postings read on a crawl of every site."""
    pages = site_pages(spark, sf)
    visits = C.crawl(pages, site_seeds(spark, sf), max_pages=8)
    return C.crawl_postings(pages, visits).select("title", "company", "url", "source", "description")


def many_site_seeds(spark, sf) -> DataFrame:
    """Two start pages per site: a page that is not there and the lowest page without a posting."""
    first = many_site_pages(spark, sf).where("page_id % 4 <> 1").groupBy("origin").agg(F.min("page_id").alias("p"))
    urls = F.array(F.concat("origin", F.lit("/jobs/none")), F.concat("origin", F.lit("/jobs/"), F.col("p").cast("string")))
    return first.select(F.col("origin").alias("site"), F.posexplode(urls).alias("pos", "url")).select("site", "url", "pos")


def crawl_many_sites(spark, sf):
    """A crawl with the default budget, over a number of sites that grows with the table."""
    visits = C.crawl(many_site_pages(spark, sf), many_site_seeds(spark, sf))
    return visits.select("site", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"), "url", "role")


def crawl_many_sites_found(spark, sf):
    """Postings read on that crawl."""
    pages = many_site_pages(spark, sf)
    return C.crawl_postings(pages, C.crawl(pages, many_site_seeds(spark, sf))).select("title", "company", "url", "source", "description")


def _board_payloads(spark, sf) -> DataFrame:
    """Every posting on a greenhouse and on a lever board, ten per request; the texts are gathered once for both."""
    v = posting_view(spark, sf).select(F.floor(F.col("posting_id") / 10).cast("int").alias("request_no"), "posting_id", "description")
    packed = v.groupBy("request_no").agg(F.collect_list(F.struct("posting_id", "description")).alias("texts"))
    green_board, lever_board = F.concat(F.lit("co"), (F.col("request_no") % 7).cast("string")), F.concat(F.lit("lv"), (F.col("request_no") % 3).cast("string"))

    def green(ids: Column, text: Column) -> Column:
        return F.struct(F.concat(F.lit("Green "), ids).alias("title"), F.concat(F.lit("https://boards.greenhouse.io/"), green_board, F.lit("/jobs/"), ids).alias("absolute_url"), H.html_escape(_markup(text)).alias("content"))

    def lever_(ids: Column, text: Column) -> Column:
        return F.struct(F.concat(F.lit("Lever "), ids).alias("text"), F.concat(F.lit("https://jobs.lever.co/"), lever_board, F.lit("/"), ids).alias("hostedUrl"), _markup(text).alias("description"))

    def listed(item: Callable[[Column, Column], Column]) -> Column:
        items = F.transform("texts", lambda i: F.struct(i["posting_id"], F.to_json(item(i["posting_id"].cast("string"), i["description"])).alias("item")))
        return F.array_join(F.transform(F.array_sort(items), lambda i: i["item"]), ",")

    is_green = F.col("provider") == "greenhouse"
    return packed.withColumn("provider", F.explode(F.array(F.lit("greenhouse"), F.lit("lever")))).select(
        "provider", F.when(is_green, green_board).otherwise(lever_board).alias("board"), "request_no", F.lit("").alias("url"),
        F.when(is_green, F.concat(F.lit('{"jobs":['), listed(green), F.lit("]}"))).otherwise(F.concat(F.lit("["), listed(lever_), F.lit("]"))).alias("payload"))


def _site_list(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed pages, landed payloads and the list of sites of a search over sites."""
    crawled = view(spark, sf, BOARD_SITE_PAGES, "pages")
    p = F.col("page_id").cast("string")
    guest = crawled.where("page_id % 10 = 0").select(
        (F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat(F.lit(rules.LINKEDIN_SEARCH + "?start="), p).alias("url"),
        F.concat(F.lit('<div class="base-card" data-entity-urn="urn:li:jobPosting:70000'), p, F.lit('"><h3 class="base-search-card__title">Guest security role '), p, F.lit("</h3></div>")).alias("html"),
    )
    raw = _board_payloads(spark, sf)
    bad = (F.col("board") == BROKEN_BOARD) & (F.col("request_no") >= BROKEN_FROM)
    raw = raw.withColumn("payload", F.when(bad, "<html>try later</html>").otherwise(F.col("payload")))
    first = crawled.where("page_id % 4 <> 1").groupBy("origin").agg(F.min("page_id").alias("p"))
    starts = first.select(
        (FIRST_SITE + F.regexp_extract("origin", "site([0-9]+)", 1).cast("bigint")).alias("pos"),
        F.concat("origin", F.lit("/jobs/"), F.col("p").cast("string")).alias("value"))
    fixed = spark.createDataFrame(FIXED_SITES, "pos bigint, value string")
    return crawled.select("page_id", "url", "html").unionByName(guest), raw, fixed.unionByName(starts)


def _of_sites(spark, sf, finish):
    pages, raw, sites = _site_list(spark, sf)
    return finish(pages, raw, None, sites, SearchSpec(**SPEC, keywords=["security"]))


def site_places(spark, sf):
    """Every posting that a run over a list of sites meets, with its place."""
    out = _of_sites(spark, sf, site_postings)
    return out.select("seq.*", "title", "url", "source", "description")


def site_search(spark, sf):
    """A search over a list of sites: boards between crawled pages, each posting where it was first met."""
    out = _of_sites(spark, sf, lambda *a: filtered_postings(site_postings(*a, once=True), a[-1]))
    return out.select("seq.*", "title", "url", "source", "remote", "summary", *joined("requirements"))


def site_search_first(spark, sf):
    """The first two hundred of them, as the search returns them."""
    out = _of_sites(spark, sf, lambda *a: search_sites(*a[:-1], SearchSpec(**SPEC, keywords=["security"], limit=200)))
    return out.select("title", "url", "source", "summary")


def linkedin(spark, sf):
    p, n = F.col("page_id").cast("string"), F.concat(F.lit("40"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    card = F.concat(
        F.lit('<li><div class="base-card job-search-card" data-entity-urn="urn:li:jobPosting:'), n,
        F.lit('"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/x-'), n, F.lit('?trk=x"></a>'
        '<h3 class="base-search-card__title"> SOC &amp; Analyst '), p, F.lit(' </h3><h4 class="base-search-card__subtitle"><a>Acme</a> <b>Inc</b></h4>'
        '<span class="job-search-card__location">United States</span><time class="job-search-card__listdate" datetime="2026-10-06">2 days ago</time></div></li>'
        '<li><div class="base-card" data-entity-urn="urn:li:jobPosting:9"><h4>no title</h4></div></li>'),
    )
    detail = F.concat(
        F.lit('<div class="show-more-less-html__markup x"><div>'), "html", F.lit('</div></div></div><ul><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Seniority level</h3>'
        '<span class="description__job-criteria-text">Entry level</span></li><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Employment type</h3>'
        '<span class="description__job-criteria-text"> Full-time </span></li></ul>'),
    )
    pages = table(spark, sf, "pages")
    details = pages.where("page_id % 3 <> 0").select(
        "page_id",
        F.concat(F.lit("https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"), n).alias("url"),
        F.concat(F.lit('<section><p>x</p>'), detail).alias("html"))
    out = W.normalize_linkedin(pages.select("page_id", "url", card.alias("html")), details, remote_only=True)
    return out.select("title", "company", "location", "remote", "url", "source", "posted_date", "employment_type", *joined("tags"))


# ---------------------------------------------------------------- sinks


def sheet_rows(spark, sf):
    rows = canonical(spark, sf).withColumns({
        "title": F.when(F.col("seq") % 4 == 0, F.concat(F.lit("  =1+"), "title")).when(F.col("seq") % 4 == 1, F.concat(F.lit("-\x01"), "title")).otherwise(F.col("title")),
        "requirements": F.array(F.lit("a"), F.lit("b")),
    })
    return cap_cells(to_sheet_rows(rows, include_description=True)).select("title", "company", "tags", "requirements", "url", "description")


def _sink(fmt: str, append: bool = False):
    """Postings written, for ``append`` in two goes, and read back from the files, beside the numbers that the writer reported."""

    def run(spark, sf):
        path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}.{fmt}"
        rows = canonical(spark, sf).withColumn("title", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("=1+"), "title")).otherwise(F.col("title")))
        even = F.col("seq") % 2 == 0
        parts = [rows.where(even), rows.where(~even)] if append else [rows]
        written = [write_postings(part, path, include_description=True, append=append) for part in parts]
        back = read_postings(spark, path)
        if fmt == "json":
            back = back.withColumns({c: F.array_join(c, "; ") for c in ("tags", "requirements")})
        return back.select("title", "company", "url", "tags", "requirements", "description", F.lit(sum(written)).cast("bigint").alias("written"))

    return run


def sink_formats(spark, sf):
    """The format that each output path stands for."""
    names = F.array(*map(F.lit, ("csv", "tsv", "tab", "json", "JSON", "txt", "")))
    named = table(spark, sf, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 7).cast("int")).alias("ext"))
    kinds = spark.createDataFrame([(e, infer_format(f"/out/jobs.{e}")) for e in ("csv", "tsv", "tab", "json", "JSON", "txt", "")], "ext string, format string")
    return named.join(F.broadcast(kinds), "ext").select("doc_id", "format")


def capped_cells(spark, sf):
    """Every text cell at the size a workbook can hold, texts four times as long."""
    rows = canonical(spark, sf).select("seq", F.repeat("description", 4).alias("description"))
    return cap_cells(rows)


def seed_lines(spark, sf):
    """A list of sites in a text file, with remarks and blank lines, routed."""
    path = f"{shared_dir(spark)}/seeds-{uuid.uuid4().hex}"
    p = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("# only a remark "), p)).when(F.col("page_id") % 4 == 1, F.lit("  ")) \
        .otherwise(F.concat(F.lit(" site"), p, F.lit(".example.com/openings  # page "), p))
    table(spark, sf, "pages").select(line.alias("value")).write.text(path)
    routed = L.read_seeds(spark, path).select("value", U.route(F.col("value")).alias("r"))
    return routed.select("value", "r.source", F.array_join("r.start_urls", " ").alias("start_urls"))


def html_content(spark, sf):
    """Pages whose content type says they are HTML, or says nothing."""
    p = F.col("page_id")
    kinds = table(spark, sf, "pages").withColumn("content_type", F.when(p % 4 == 0, "text/html; charset=utf-8").when(p % 4 == 1, "application/pdf").when(p % 4 == 2, "application/xhtml+xml"))
    return P.html_only(kinds).select("page_id", "url")


def page_dates(spark, sf):
    """Date hints of a page in the order in which they count."""
    p = F.col("page_id")
    head = F.concat(F.when(p % 3 == 0, F.concat(F.lit('<meta name="date" content="2027-01-'), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit('">'))).otherwise(""),
                    F.when(p % 5 == 0, F.lit('<meta property="article:published_time" content=" 2027-02-02 ">')).otherwise(""))
    time = F.when(p % 4 == 1, F.lit('<time datetime="2027-03-03">x</time>')).when(p % 4 == 2, F.lit("<time>5 <b>March</b></time>")).otherwise("")
    pages = table(spark, sf, "pages").withColumn("html", F.concat(head, time, "html"))
    feats = W.page_features(pages)
    return feats.select("page_id", F.col("meta_posted"), F.col("time_posted"), W.page_posted(F.col("meta_posted"), F.col("time_posted"), F.lit("")).alias("posted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    text = P.search_text
    return {
        "keyword_any": _where(lambda: P.match_any(text(), ["data engineer", "help-desk", "VPN"])),
        "keyword_all": _where(lambda: P.match_all(text(), ["full time", "security"])),
        "keyword_none": _where(lambda: P.match_none(text(), ["senior", "remote"])),
        "title_only": _where(lambda: P.match_any(text(title_only=True), ["cyber security", "SOC"])),
        "field_search": _where(lambda: P.match_any(text(), rules.expand_fields(["Cybersecurity", "it_support"]))),
        "term_table": term_table,
        "remote_class": remote_class,
        "remote_filter": remote_filter,
        "posted_parse": posted_parse,
        "posted_within": _where(lambda: P.posted_within(F.col("posted_raw"), 5, today())),
        "posted_within_or_undated": _where(lambda: P.posted_within(F.col("posted_raw"), 5, today(), True)),
        "location_any": _where(lambda: P.location_any(["austin", "BERLIN"])),
        "domain_allow": _where(lambda: P.domain_pred(F.col("url"), allow=["https://www.example.com/x"])),
        "domain_deny": _where(lambda: P.domain_pred(F.col("url"), deny=["example.com", ".other.test"])),
        "domain_table": domain_table,
        "full_filter": filtered,
        "education": _mined("education", detect_education),
        "certifications": _mined("certifications", lambda c: F.array_join(detect_certifications(c), "|")),
        "clearance": _mined("clearance", lambda c: F.array_join(detect_clearance(c), "|")),
        "experience": _mined("experience", detect_experience),
        "requirements": _mined("requirements", lambda c: F.array_join(X.extract_requirements(c), "|")),
        "summary": _mined("summary", X.summarize),
        "enrich": enriched,
        "distinct_first": distinct_hosts,
        "dedupe_postings": dedupe,
        "first_matches": limited,
        "search_end_to_end": search,
        "stream_ingest": stream,
        "stream_quarantine": stream_quarantine,
        "normalize_remoteok": remoteok,
        "normalize_remotive": remotive,
        "normalize_arbeitnow": arbeitnow,
        "normalize_greenhouse": greenhouse,
        "normalize_lever": lever,
        "normalize_workday": workday,
        "select_sources": select_by_name,
        "union_sources": sources_union,
        "quarantine": quarantine,
        "quarantine_faults": quarantine_faults,
        "jsonld_postings": jsonld,
        "html_text": html_text,
        "page_links": page_links,
        "html_page_postings": html_pages,
        "page_titles": page_titles,
        "board_links": boards_found,
        "route_urls": routes,
        "robots_filter": robots,
        "crawl_reachable": crawl_reachable,
        "crawl_postings": crawl_found,
        "crawl_many_sites": crawl_many_sites,
        "crawl_many_sites_postings": crawl_many_sites_found,
        "site_places": site_places,
        "site_search": site_search,
        "site_search_first": site_search_first,
        "linkedin_postings": linkedin,
        "sheet_rows": sheet_rows,
        "sink_csv": _sink("csv"),
        "sink_tsv_append": _sink("tsv", append=True),
        "sink_json": _sink("json"),
        "sink_json_append": _sink("json", append=True),
        "sink_formats": sink_formats,
        "capped_cells": capped_cells,
        "seed_lines": seed_lines,
        "html_content": html_content,
        "page_dates": page_dates,
    }
