"""Postings read from landed web pages: schema.org data, plain HTML, and LinkedIn result and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import html as H, jsonld as J, urls as U
from ..functions.core import first_filled, keep_rows, let, split_lines, text_or_empty, trim_ws, unnest
from ..functions.detect import detect_education, detect_experience
from ..operators.distinct import distinct_first
from ..schema import REMOTE, UNKNOWN
from .postings import as_postings, sequence_of


def _rank(df: DataFrame) -> Column:
    return F.col("source_rank") if "source_rank" in df.columns else F.lit(0)


def _page_source(pages: DataFrame) -> Column:
    """Site name set by a crawl, else the page's host."""
    own = F.col("site") if "site" in pages.columns else F.lit("")
    return first_filled(own, U.host(F.col("url")))


def jsonld_objects(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD posting object: all page columns but the markup, plus ``item_pos`` and ``obj``."""
    J.let_last_key_win(pages.sparkSession)
    kept = [c for c in pages.columns if c != "html"]
    scripts = F.filter(H.json_ld(F.col("html")), lambda s: s.contains("JobPosting"))
    # All objects of a page stand in one array, scripts first, so their positions count through.
    found = unnest(pages.where(F.col("html").contains("ld+json")), kept, F.flatten(F.transform(scripts, J.objects)), "obj", "item_pos")
    return found.where(J.is_posting(F.col("obj")))


def normalize_jsonld(pages: DataFrame) -> DataFrame:
    """Postings embedded as schema.org ``JobPosting`` objects."""
    rows = jsonld_objects(pages)

    def value(name: str) -> Column:
        return J.member(F.col("obj"), name)

    # Text members are flattened in one pass over an array of them, then decoded and stripped in a second
    # projection: each expression exists once in the plan, and nothing is read twice.
    flat = ["hiringOrganization", "url", "datePosted", "employmentType", "industry", "occupationalCategory",
            "educationRequirements", "experienceRequirements", "qualifications", "skills", "description"]
    title = F.coalesce(J.filled(value("title")), value("name"))
    rows = rows.withColumn("_t", F.transform(F.array(title, *map(value, flat)), J.as_text))
    text = {n: F.get("_t", F.lit(i)) for i, n in enumerate(["title", *flat])}
    rows = rows.withColumns({
        "_plain": F.transform(F.array(text["title"], text["hiringOrganization"]), H.html_unescape),
        "_html": F.transform(
            F.array(first_filled(text["qualifications"], text["skills"]), text["description"]), H.html_to_text
        ),
        "_education": text["educationRequirements"], "_experience": text["experienceRequirements"],
    })
    months = F.when(
        J.kind(value("experienceRequirements")) == "OBJECT",
        J.months_as_years(J.member(value("experienceRequirements"), "monthsOfExperience")),
    )
    page_no = F.col("page_no") if "page_no" in rows.columns else F.col("page_id")
    return as_postings(
        rows, sequence_of(_rank(rows), F.lit(""), page_no, F.col("item_pos")),
        title=F.get("_plain", F.lit(0)), company=F.get("_plain", F.lit(1)),
        location=J.location_text(value("jobLocation")),
        remote=F.when(F.upper(text_or_empty(value("jobLocationType").try_cast("string"))) == "TELECOMMUTE", REMOTE)
        .otherwise(UNKNOWN),
        url=U.join_url(F.col("url"), first_filled(text["url"], F.col("url"))),
        source=_page_source(rows),
        posted_date=F.substring(text["datePosted"], 1, 10), employment_type=text["employmentType"],
        salary=J.salary_of(value("baseSalary")),
        tags=F.filter(F.array(text["industry"], text["occupationalCategory"]), lambda t: t != ""),
        education=first_filled(
            detect_education(F.col("_education")), F.substring("_education", 1, rules.RAW_TEXT_CHARS)
        ),
        experience=first_filled(
            F.coalesce(months, F.lit("")), detect_experience(F.col("_experience")),
            F.substring("_experience", 1, rules.RAW_TEXT_CHARS),
        ),
        requirements=F.slice(
            F.filter(split_lines(F.get("_html", F.lit(0))), lambda x: x != ""), 1, rules.MAX_REQUIREMENTS
        ),
        description=F.get("_html", F.lit(1)),
    )


def page_title(h1: Column, title_tag: Column, og_title: Column) -> Column:
    """``og:title``, else the title tag when it contains the heading, else heading, else title tag."""
    return first_filled(
        og_title, F.when((h1 != "") & title_tag.contains(h1), title_tag).otherwise(first_filled(h1, title_tag))
    )


def split_title(title: Column, site_name: Column, url: Column) -> Column:
    """Struct of ``title`` and ``company``; a trailing site name is dropped."""
    label = F.split_part(U.bare_host(url), F.lit("."), F.lit(1))

    def squeeze(v: Column) -> Column:
        return F.replace(F.lower(v), F.lit(" "), F.lit(""))

    def without_site(parts: Column) -> Column:
        last = squeeze(trim_ws(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))))
        named = (last == squeeze(site_name)) | (last == label)
        return F.when(
            (F.size(parts) > 1) & named,
            F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " - "),
        ).otherwise(title)

    def pair(t: Column) -> Column:
        separator = F.when(t.contains(" : "), F.lit(" : ")).when(t.rlike(r"(?U)\s+at\s+"), F.lit(r"(?U)\s+at\s+"))
        parts = F.split(t, F.coalesce(separator, F.lit(" : ")), 2)
        return F.struct(
            F.when(separator.isNull(), t).otherwise(trim_ws(F.get(parts, F.lit(0)))).alias("title"),
            F.when(separator.isNull(), "").otherwise(trim_ws(F.get(parts, F.lit(1)))).alias("company"),
        )

    return let(let(F.split(title, rules.TITLE_SEPARATOR), without_site), pair)


def page_features(pages: DataFrame) -> DataFrame:
    """Title parts, main text and date hints of each page, one projection per step so nothing is read twice."""
    kept = [c for c in pages.columns if c != "html"]
    shown = pages.select(*kept, H.strip_hidden(F.col("html")).alias("_shown"))
    shown = shown.select(
        *kept, "_shown", H.meta_tags(F.col("_shown")).alias("_meta"),
        H.drop_elements(F.col("_shown"), rules.PAGE_CHROME).alias("_body"),
    )
    body, page = F.col("_body"), F.col("_shown")
    container = first_filled(
        H.opening_tag(body, H.attr_matches("class", rules.CONTAINER_NAME)),
        H.opening_tag(body, H.attr_matches("id", rules.CONTAINER_NAME)),
        H.opening_tag(body, r"article(?![\w-])"), H.opening_tag(body, r"main(?![\w-])"),
        H.opening_tag(body, r"body(?![\w-])"),
    )
    out = shown.select(
        *kept,
        F.array(
            H.meta(F.col("_meta"), ["og:site_name"]), H.meta(F.col("_meta"), ["og:title"]),
            H.meta(F.col("_meta"), rules.POSTED_META),
            H.mark_pieces(H.element(page, r"h1(?![\w-])")), H.mark_pieces(H.element(page, r"title(?![\w-])")),
        ).alias("_raw"),
        H.opening_tag(body, r"time(?![\w-])").alias("_time"),
        container.alias("_container"), "_body",
    )
    # All short texts are decoded by one expression over an array of them.
    out = out.select(
        *kept, "_container", "_body",
        F.transform(
            F.concat("_raw", F.array(
                H.raw_attribute(F.regexp_extract("_time", r"(?s)^<[^>]*>", 0), "datetime"),
                H.mark_pieces(H.balanced(F.col("_time"))),
            )),
            lambda raw: H.pieces_text(H.html_unescape(raw)),
        ).alias("_texts"),
    )
    names = ["site_name", "og_title", "meta_posted", "h1", "title_tag", "time_attr", "time_text"]
    texts = {n: F.get("_texts", F.lit(i)) for i, n in enumerate(names)}
    return out.select(
        *kept, *[texts[n].alias(n) for n in names[:5]],
        first_filled(texts["time_attr"], texts["time_text"]).alias("time_posted"),
        H.visible_text(
            F.when(F.col("_container") != "", H.balanced(F.col("_container"))).otherwise(F.col("_body"))
        ).alias("main_text"),
    )


def page_posted(meta_posted: Column, time_posted: Column, text: Column) -> Column:
    return first_filled(meta_posted, time_posted, F.regexp_extract(text, rules.POSTED_PHRASE, 0))


def normalize_html_page(pages: DataFrame) -> DataFrame:
    """At most one posting per page without structured data; thin or untitled pages give none."""
    title = page_title(F.col("h1"), F.col("title_tag"), F.col("og_title"))
    feats = page_features(pages).withColumn("_t", split_title(title, F.col("site_name"), F.col("url")))
    feats = keep_rows(
        feats, lambda r: (F.length(r["main_text"]) >= rules.MIN_PAGE_TEXT) & (r["_t"]["title"] != "")
    )
    page_no = F.col("page_no") if "page_no" in feats.columns else F.col("page_id")
    names = F.array(F.col("_t.title"), first_filled(F.col("_t.company"), F.col("site_name")))
    feats = feats.withColumn("_names", F.transform(names, H.html_unescape))
    return as_postings(
        feats, sequence_of(_rank(feats), F.lit(""), page_no, F.lit(0)),
        title=F.get("_names", F.lit(0)), company=F.get("_names", F.lit(1)),
        url=U.drop_fragment(F.col("url")), source=_page_source(feats),
        posted_date=page_posted(F.col("meta_posted"), F.col("time_posted"), F.col("main_text")),
        description=F.col("main_text"),
    )


def _opening_of_class(fragment: Column, name: Column) -> Column:
    """``opening_tag`` for a class name that is itself a column."""
    before, after = H.has_class("\x00").split("\x00")
    pattern = F.concat(F.lit(r"(?is)<" + before), name, F.lit(after + ".*"))
    return F.call_function("regexp_extract", fragment, pattern, F.lit(0))


def _pieces(page: Column, condition: str) -> Column:
    """The page cut at every opening tag matching ``condition``, what precedes the first one left out."""
    start = rf"(?is)(?=<{condition})"
    return F.filter(F.split(page, start), lambda p: p.rlike(rf"(?is)\A<{condition}"))


def linkedin_cards(pages: DataFrame) -> DataFrame:
    """Result cards as postings with their ``job_id``; cards without title or URL are dropped."""
    kept = [c for c in pages.columns if c != "html"]
    shown = pages.select(*kept, H.strip_hidden(F.col("html")).alias("_shown"))
    by_urn = _pieces(F.col("_shown"), H.attr_matches("data-entity-urn", "jobPosting"))
    by_class = _pieces(F.col("_shown"), H.has_class("base-card"))
    pieces = let(by_urn, lambda c: F.when(F.size(c) > 0, c).otherwise(by_class))
    cards = unnest(shown, kept, pieces, "_piece", "item_pos")
    opening = F.regexp_extract("_piece", r"(?s)^<[^>]*>", 0)
    cards = cards.select(*kept, "item_pos", opening.alias("_tag"), H.balanced(F.col("_piece")).alias("_card"))
    card, tag = F.col("_card"), F.col("_tag")

    def tag_only(condition: str) -> Column:
        return F.regexp_extract(H.opening_tag(card, condition), r"(?s)^<[^>]*>", 0)

    link = first_filled(
        tag_only(H.has_class("base-card__full-link").replace("[a-z][a-z0-9]*", "a", 1)),
        tag_only(H.attr_matches("href", "/jobs/view/").replace("[a-z][a-z0-9]*", "a", 1)),
        F.when(tag.rlike(r"(?i)^<a(?![\w-])"), tag),
    )
    cards = cards.withColumn("_href", H.attribute(link, "href")).withColumn(
        "job_id", U.linkedin_job_id(H.attribute(tag, "data-entity-urn"), F.col("_href"))
    )
    time = H.opening_tag(card, r"time(?![\w-])")
    classes = ["base-search-card__title", "base-search-card__subtitle", "job-search-card__location",
               "job-search-card__salary-info"]
    cards = cards.withColumn(
        "_texts",
        F.transform(
            F.array(
                *[H.mark_pieces(H.element(card, H.has_class(c))) for c in classes],
                H.raw_attribute(F.regexp_extract(time, r"(?s)^<[^>]*>", 0), "datetime"), H.mark_pieces(H.balanced(time)),
            ),
            lambda raw: H.pieces_text(H.html_unescape(raw)),
        ),
    )
    texts = [F.get("_texts", F.lit(i)) for i in range(6)]
    cards = cards.select(
        *kept, "item_pos", "job_id", texts[0].alias("title"), texts[1].alias("company"), texts[2].alias("location"),
        texts[3].alias("salary"), first_filled(texts[4], texts[5]).alias("posted"),
        F.when(
            F.col("job_id") != "",
            F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("job_id"), F.lit("/")),
        ).otherwise(F.split_part("_href", F.lit("?"), F.lit(1))).alias("card_url"),
    )
    return keep_rows(cards, lambda r: (r["title"] != "") & (r["card_url"] != ""))


def linkedin_details(pages: DataFrame) -> DataFrame:
    """Description, employment type and further tags per ``job_id``; of several copies the first page counts."""
    job_id = F.regexp_extract("url", r"/jobPosting/(\d+)", 1)
    landed = pages.select(job_id.alias("job_id"), "page_id", "html").where("job_id <> ''")
    shown = distinct_first(landed, ["job_id"], "page_id").select("job_id", H.strip_hidden(F.col("html")).alias("_shown"))
    page = F.col("_shown")
    markup = first_filled(
        H.opening_tag(page, H.has_class("show-more-less-html__markup")),
        H.opening_tag(page, H.has_class("description__text")),
    )
    # Heading and value of every criteria item, decoded by one expression.
    parts = ["description__job-criteria-subheader", "description__job-criteria-text"]
    items = F.transform(
        _pieces(page, H.has_class("description__job-criteria-item")),
        lambda p: F.transform(
            F.transform(F.array(*map(F.lit, parts)), lambda c: H.mark_pieces(let(_opening_of_class(p, c), H.balanced))),
            lambda raw: H.pieces_text(H.html_unescape(raw)),
        ),
    )
    items = F.transform(items, lambda t: F.struct(
        F.lower(F.get(t, F.lit(0))).alias("header"), F.get(t, F.lit(1)).alias("value")))
    rows = shown.select(
        "job_id", H.html_to_text(H.balanced(markup)).alias("detail_text"),
        F.filter(items, lambda i: i["value"] != "").alias("_items"),
    )
    is_type = lambda i: i["header"].contains("employment type")
    types = F.transform(F.filter("_items", is_type), lambda i: i["value"])
    return rows.select(
        "job_id", "detail_text",
        F.coalesce(F.get(types, F.size(types) - 1), F.lit("")).alias("detail_type"),
        F.transform(F.filter("_items", lambda i: ~is_type(i)), lambda i: i["value"]).alias("detail_tags"),
    )


def linkedin_landed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The result pages and the detail pages among landed pages, told apart by their address."""
    return pages.where(F.col("url").startswith(rules.LINKEDIN_SEARCH)), pages.where(F.col("url").startswith(rules.LINKEDIN_DETAIL))


def normalize_linkedin(results: DataFrame, details: DataFrame, remote_only: bool = False,
                       include_hybrid: bool = False) -> DataFrame:
    """Cards left-joined to their detail pages; a search for remote jobs alone marks every card Remote."""
    cards = linkedin_cards(results).withColumn("job_id", F.nullif("job_id", F.lit("")))
    # A card without an id has no details.  Its own address keeps it out of the way: such cards spread over all tasks.
    cards = cards.withColumn("_key", F.coalesce("job_id", F.concat(F.lit("\x00"), "card_url"))).drop("job_id")
    rows = cards.join(linkedin_details(details).withColumnRenamed("job_id", "_key"), "_key", "left")
    page_no = F.col("request_no") if "request_no" in rows.columns else F.col("page_id")
    return as_postings(
        rows, sequence_of(_rank(rows), F.lit(""), page_no, F.col("item_pos")),
        title=F.col("title"), company=F.col("company"), location=F.col("location"),
        remote=F.lit(REMOTE if remote_only and not include_hybrid else UNKNOWN),
        url=F.col("card_url"), source=F.lit("linkedin"), posted_date=F.col("posted"), salary=F.col("salary"),
        employment_type=F.col("detail_type"), tags=F.array_distinct(F.col("detail_tags")),
        description=F.col("detail_text"),
    )
