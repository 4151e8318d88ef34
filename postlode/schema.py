"""Record layouts: the canonical posting, the landed tables and the provider payloads."""

from __future__ import annotations

# --- Fixed values: work-arrangement labels, export column order, provider payload members ---
REMOTE = "Remote"
HYBRID = "Hybrid"
ONSITE = "On-site"
UNKNOWN = "Unknown"

COLUMNS = [
    "title", "company", "location", "remote", "url", "source", "posted_date", "employment_type", "salary",
    "tags", "summary", "education", "certifications", "experience", "clearance", "requirements",
]

PAYLOAD_DDL = {
    "remoteok": (
        "id STRING, position STRING, company STRING, location STRING, url STRING, date STRING, "
        "salary_min STRING, salary_max STRING, tags ARRAY<STRING>, description STRING"
    ),
    "remotive": (
        "title STRING, company_name STRING, url STRING, category STRING, job_type STRING, "
        "candidate_required_location STRING, publication_date STRING, salary STRING, tags ARRAY<STRING>, "
        "description STRING"
    ),
    "arbeitnow": (
        "title STRING, company_name STRING, location STRING, url STRING, remote BOOLEAN, created_at STRING, "
        "job_types ARRAY<STRING>, tags ARRAY<STRING>, description STRING"
    ),
    "greenhouse": (
        "title STRING, absolute_url STRING, company_name STRING, location STRUCT<name: STRING>, "
        "first_published STRING, updated_at STRING, departments ARRAY<STRUCT<name: STRING>>, content STRING"
    ),
    "lever": (
        "text STRING, hostedUrl STRING, workplaceType STRING, "
        "categories STRUCT<location: STRING, commitment: STRING, team: STRING, department: STRING>, "
        "createdAt STRING, description STRING, lists ARRAY<STRUCT<text: STRING, content: STRING>>, "
        "additional STRING, salaryRange STRUCT<min: STRING, max: STRING, currency: STRING, interval: STRING>"
    ),
    "workday_listing": (
        "title STRING, externalPath STRING, locationsText STRING, postedOn STRING, remoteType STRING, "
        "bulletFields ARRAY<STRING>"
    ),
    "workday_detail": (
        "jobPostingInfo STRUCT<title: STRING, location: STRING, additionalLocations: ARRAY<STRING>, "
        "remoteType: STRING, timeType: STRING, startDate: STRING, postedOn: STRING, externalUrl: STRING, "
        "jobDescription: STRING>, hiringOrganization STRUCT<name: STRING>"
    ),
}
# What each provider's payload is: a list, or an object with a list (or an object) under the named member.
PAYLOAD_SHAPE = {
    "remoteok": ("ARRAY", None),
    "remotive": ("OBJECT", "jobs"),
    "arbeitnow": ("OBJECT", "data"),
    "greenhouse": ("OBJECT", "jobs"),
    "lever": ("ARRAY", None),
    "workday": ("OBJECT", "jobPostings"),
    "workday_detail": ("OBJECT", "jobPostingInfo"),
}
# --- End of fixed values ---

ARRAY_COLUMNS = ("tags", "certifications", "clearance", "requirements")

RAW_DDL = (
    "provider STRING, board STRING, request_no INT, url STRING, payload STRING, fetched_at TIMESTAMP"
)
PAGES_DDL = "page_id BIGINT, url STRING, html STRING, content_type STRING, status INT"
ROBOTS_DDL = "origin STRING, status INT, body STRING"

# Emission order of a posting: source, board, request (or page) and position in it.  Structs compare member by
# member, so no row number has to be computed to order postings across the whole input.
SEQ_DDL = "STRUCT<source_rank: INT, board: STRING, request_no: BIGINT, item_pos: INT>"

POSTING_DDL = ", ".join(
    ["seq " + SEQ_DDL]
    + [f"{c} {'ARRAY<STRING>' if c in ARRAY_COLUMNS else 'STRING'}" for c in COLUMNS + ["description"]]
)
