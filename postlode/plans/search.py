"""The search job: union, dedupe, enrich, filter, limit, project."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..operators import filters as P
from ..operators.dedupe import dedupe_postings
from ..operators.enrich import enrich
from ..sources.postings import project_postings


@dataclass
class SearchSpec:
    """What to look for.  ``as_of`` stands for today throughout."""

    as_of: date
    keywords: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    require: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    title_only: bool = False
    remote_only: bool = False
    include_hybrid: bool = False
    locations: list[str] = field(default_factory=list)
    posted_within_days: int | None = None
    include_undated: bool = False
    domains: list[str] = field(default_factory=list)
    exclude_domains: list[str] = field(default_factory=list)
    limit: int | None = None
    include_description: bool = False
    summary_chars: int = rules.SUMMARY_CHARS

    def __post_init__(self) -> None:
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be at least 1")
        if self.posted_within_days is not None and self.posted_within_days < 0:
            raise ValueError("posted_within_days must not be negative")
        self.terms = self.keywords + rules.expand_fields(self.fields)

    @property
    def today(self) -> Column:
        return F.lit(self.as_of).cast("date")


def postings_filter(spec: SearchSpec) -> Column:
    """All conditions of a search as one predicate, cheap ones first."""
    cond = F.lit(True)
    if spec.remote_only:
        cond = cond & P.remote_pred(spec.include_hybrid)
    if spec.posted_within_days is not None:
        cond = cond & P.posted_within(
            F.col("posted_date"), spec.posted_within_days, spec.today, spec.include_undated
        )
    if spec.locations:
        cond = cond & P.location_any(spec.locations)
    if spec.domains or spec.exclude_domains:
        cond = cond & P.domain_pred(F.col("url"), spec.domains, spec.exclude_domains)
    text = P.search_text(spec.title_only)
    if spec.terms:
        cond = cond & P.match_any(text, spec.terms)
    return cond & P.match_all(text, spec.require) & P.match_none(text, spec.exclude)


def first_matches(df: DataFrame, limit: int | None, order_by: str = "seq") -> DataFrame:
    """The first ``limit`` rows in posting order; every row when there is no limit."""
    return df if limit is None else df.orderBy(order_by).limit(limit)


def search_postings(postings: DataFrame, spec: SearchSpec, order_by: str = "seq") -> DataFrame:
    """Run a search over unioned postings.

    Duplicates go first: a posting that fails the filter still suppresses its duplicates.  Enrichment then runs
    on the survivors only, and columns that the output does not need are pruned from it.
    """
    found = filtered_postings(postings, spec, order_by)
    return project_postings(first_matches(found, spec.limit, order_by), spec.include_description)


def filtered_postings(postings: DataFrame, spec: SearchSpec, order_by: str = "seq") -> DataFrame:
    """What a search finds, with all columns and the order it is in."""
    return enrich(dedupe_postings(postings, order_by), spec.today, spec.summary_chars).where(postings_filter(spec))
