"""Normalisers for the JSON posting systems: one landed payload row in, its postings out.

Each is a projection over ``raw`` (parse, explode, select) with no shuffle; only the detail join of the two-step
provider moves data.  ``raw`` may carry ``source_rank`` (see ``registry.select_sources``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.core import first_filled, let, text_or_empty, tidy_array, unnest
from ..functions.dates import date_from_epoch, parse_date
from ..functions.detect import map_workplace
from ..functions.html import html_escape, html_to_text, html_unescape
from ..functions.salary import salary_text
from ..operators.distinct import distinct_first
from ..schema import PAYLOAD_DDL, REMOTE, UNKNOWN
from .postings import as_postings, sequence_of


def _of(raw: DataFrame, provider: str) -> DataFrame:
    raw = raw.where(F.col("provider") == provider)
    return raw if "source_rank" in raw.columns else raw.withColumn("source_rank", F.lit(0))


def _explode(raw: DataFrame, items: Column) -> DataFrame:
    return unnest(raw, ["source_rank", "board", "request_no"], items, "item", "item_pos")


def _listed(raw: DataFrame, member: str, ddl: str) -> DataFrame:
    parsed = F.from_json("payload", f"STRUCT<{member}: ARRAY<STRUCT<{_nested(ddl)}>>>")
    return _explode(raw, parsed[member])


def _nested(ddl: str) -> str:
    """Top-level ``name TYPE`` pairs as struct members."""
    depth, out = 0, []
    for part in ddl.replace(", ", ",\n").split("\n"):
        if depth == 0:
            part = part.replace(" ", ": ", 1)
        depth += part.count("<") - part.count(">")
        out.append(part)
    return " ".join(out)


def _seq() -> Column:
    return sequence_of(F.col("source_rank"), F.col("board"), F.col("request_no"), F.col("item_pos"))


def _day(value: Column) -> Column:
    return F.substring(text_or_empty(value), 1, 10)


def normalize_remoteok(raw: DataFrame) -> DataFrame:
    """A list whose first element is a legal notice; only objects with a position are postings."""
    items = F.filter(
        F.from_json("payload", "ARRAY<STRING>"),
        lambda x: F.ltrim(x).startswith("{"),
    )
    rows = _explode(_of(raw, "remoteok"), F.transform(items, lambda x: F.from_json(x, PAYLOAD_DDL["remoteok"])))
    i = F.col("item")
    rows = rows.where(i["position"] != "")
    return as_postings(
        rows, _seq(),
        title=i["position"], company=i["company"], location=i["location"], remote=F.lit(REMOTE),
        url=first_filled(i["url"], F.concat(F.lit("https://remoteok.com/remote-jobs/"), text_or_empty(i["id"]))),
        source=F.lit("remoteok"), posted_date=_day(i["date"]),
        salary=salary_text(i["salary_min"], i["salary_max"], F.lit("USD"), F.lit("")),
        tags=i["tags"], description=html_to_text(i["description"]),
    )


def _title_case(value: Column) -> Column:
    """Capital first letter of every run of letters, the rest small."""
    runs = F.regexp_extract_all(value, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), ""
    )


def normalize_remotive(raw: DataFrame) -> DataFrame:
    rows = _listed(_of(raw, "remotive"), "jobs", PAYLOAD_DDL["remotive"])
    i = F.col("item")
    category = F.when(i["category"] != "", F.array(i["category"])).otherwise(F.array().cast("array<string>"))
    return as_postings(
        rows, _seq(),
        title=i["title"], company=i["company_name"], location=i["candidate_required_location"], remote=F.lit(REMOTE),
        url=i["url"], source=F.lit("remotive"), posted_date=_day(i["publication_date"]),
        employment_type=_title_case(F.replace(text_or_empty(i["job_type"]), F.lit("_"), F.lit(" "))),
        salary=i["salary"], tags=F.concat(category, tidy_array(i["tags"])), description=html_to_text(i["description"]),
    )


def normalize_arbeitnow(raw: DataFrame) -> DataFrame:
    """Every landed page is read: when to stop asking for pages is a question of fetching them."""
    rows = _listed(_of(raw, "arbeitnow"), "data", PAYLOAD_DDL["arbeitnow"])
    i = F.col("item")
    return as_postings(
        rows, _seq(),
        title=i["title"], company=i["company_name"], location=i["location"],
        remote=F.when(i["remote"], REMOTE).otherwise(UNKNOWN), url=i["url"], source=F.lit("arbeitnow"),
        posted_date=date_from_epoch(i["created_at"]), employment_type=F.array_join(tidy_array(i["job_types"]), ", "),
        tags=i["tags"], description=html_to_text(i["description"]),
    )


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    """Departments become tags; the content is HTML that was escaped once more."""
    rows = _listed(_of(raw, "greenhouse"), "jobs", PAYLOAD_DDL["greenhouse"])
    i, board = F.col("item"), F.col("board")
    return as_postings(
        rows, _seq(),
        title=i["title"], company=first_filled(i["company_name"], board), location=i["location"]["name"],
        url=i["absolute_url"], source=F.concat(F.lit("greenhouse:"), board),
        posted_date=_day(first_filled(i["first_published"], i["updated_at"])),
        tags=F.filter(F.transform(i["departments"], lambda d: d["name"]), lambda n: n != ""),
        description=html_to_text(html_unescape(text_or_empty(i["content"]))),
    )


def normalize_lever(raw: DataFrame) -> DataFrame:
    """Description, list blocks and closing text are joined into one document before the markup is removed."""
    items = F.from_json("payload", f"ARRAY<STRUCT<{_nested(PAYLOAD_DDL['lever'])}>>")
    rows = _explode(_of(raw, "lever"), items)
    i, board = F.col("item"), F.col("board")
    cat, pay = i["categories"], i["salaryRange"]
    blocks = F.transform(
        F.coalesce(i["lists"], F.array().cast("array<struct<text:string,content:string>>")),
        lambda b: F.concat(
            F.lit("<h3>"), html_escape(text_or_empty(b["text"])), F.lit("</h3><ul>"), text_or_empty(b["content"]),
            F.lit("</ul>"),
        ),
    )
    interval = F.replace(
        F.regexp_replace(text_or_empty(pay["interval"]), "^per-|-salary$", ""), F.lit("-"), F.lit(" ")
    )
    return as_postings(
        rows, _seq(),
        title=i["text"], company=board, location=cat["location"], remote=map_workplace(i["workplaceType"], "lever"),
        url=i["hostedUrl"], source=F.concat(F.lit("lever:"), board),
        posted_date=date_from_epoch(i["createdAt"], millis=True), employment_type=cat["commitment"],
        salary=salary_text(pay["min"], pay["max"], pay["currency"], interval),
        tags=F.filter(F.array(cat["team"], cat["department"]), lambda t: t != ""),
        description=html_to_text(
            F.concat(text_or_empty(i["description"]), F.array_join(blocks, ""), text_or_empty(i["additional"]))
        ),
    )


def workday_details(raw: DataFrame) -> DataFrame:
    """One row per detail document, keyed by board and posting path."""
    path = F.regexp_extract("url", r"^https?://[^/]+/wday/cxs/[^/]+/[^/]+(/.*)$", 1)
    rows = raw.where(F.col("provider") == "workday_detail").select("board", path.alias("path"), "request_no", "payload")
    first = distinct_first(rows, ["board", "path"], "request_no")
    parsed = F.from_json("payload", f"STRUCT<{_nested(PAYLOAD_DDL['workday_detail'])}>")
    return first.select("board", "path", parsed.alias("detail"))


def normalize_workday(raw: DataFrame, as_of: Column) -> DataFrame:
    """Listing rows with their detail documents; a missing detail falls back to the listing.

    ``board`` is ``<host>/<site>``.  A path repeated over search terms counts once, at its first place.
    """
    rows = _listed(_of(raw, "workday"), "jobPostings", PAYLOAD_DDL["workday_listing"])
    rows = rows.withColumn("path", F.col("item.externalPath")).where("path <> ''")
    rows = rows.withColumn("seq", _seq())
    rows = distinct_first(rows, ["board", "path"], "seq")
    rows = rows.join(workday_details(raw), ["board", "path"], "left")
    i, info = F.col("item"), F.col("detail.jobPostingInfo")
    tenant = F.split_part("board", F.lit("."), F.lit(1))
    host, site = F.split_part("board", F.lit("/"), F.lit(1)), F.split_part("board", F.lit("/"), F.lit(2))
    places = F.filter(
        F.concat(F.array(info["location"]), tidy_array(info["additionalLocations"])), lambda x: x != ""
    )
    start = parse_date(info["startDate"], as_of)
    return as_postings(
        rows, F.col("seq"),
        title=first_filled(info["title"], i["title"]),
        company=first_filled(F.col("detail.hiringOrganization.name"), tenant),
        location=first_filled(F.array_join(places, "; "), i["locationsText"]),
        remote=map_workplace(first_filled(info["remoteType"], i["remoteType"]), "workday"),
        url=first_filled(
            info["externalUrl"], F.concat(F.lit("https://"), host, F.lit("/"), site, F.col("path"))
        ),
        source=F.concat(F.lit("workday:"), tenant, F.lit("/"), site),
        posted_date=let(
            start,
            lambda d: F.when(d <= as_of, F.date_format(d, "yyyy-MM-dd")).otherwise(
                first_filled(info["postedOn"], i["postedOn"])
            ),
        ),
        employment_type=info["timeType"], tags=i["bulletFields"], description=html_to_text(info["jobDescription"]),
    )
