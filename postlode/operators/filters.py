"""Search predicates.  Each returns a boolean Column or a narrower DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import urls as U
from ..functions.core import WS, fold_case, holds_any, let, text_or_empty, unnest
from ..functions.dates import parse_date
from ..schema import HYBRID, REMOTE
from ..session import cut


def search_text(title_only: bool = False) -> Column:
    """What keyword terms are matched against."""
    if title_only:
        return text_or_empty(F.col("title"))
    return F.concat_ws(
        "\n", text_or_empty(F.col("title")), text_or_empty(F.array_join("tags", " ")),
        text_or_empty(F.col("description")),
    )


def _term_hits(text: Column, terms: list[str]) -> Column:
    """Array with one truth value per term.

    A term's pattern is tried only on texts that contain its longest word, so terms absent from a text cost one
    byte search each, however many there are.
    """

    def hit(v: Column, term: str) -> Column:
        word = max(re.split(r"[\s-]+", term.strip()), key=len)
        found = v["text"].rlike(rules.term_pattern(term))
        return holds_any(v["folded"], [word.replace("\u0130", "i").upper().lower()]) & found if word else found

    return let(
        let(text, lambda t: F.struct(t.alias("text"), fold_case(t).alias("folded"))),
        lambda v: F.array(*[hit(v, t) for t in terms]),
    )


def match_any(text: Column, terms: list[str]) -> Column:
    terms = [t for t in terms if t.strip()]
    return F.exists(_term_hits(text, terms), lambda hit: hit) if terms else F.lit(True)


def match_all(text: Column, terms: list[str]) -> Column:
    terms = [t for t in terms if t.strip()]
    return F.forall(_term_hits(text, terms), lambda hit: hit) if terms else F.lit(True)


def match_none(text: Column, terms: list[str]) -> Column:
    return ~match_any(text, terms) if any(t.strip() for t in terms) else F.lit(True)


def remote_pred(include_hybrid: bool = False) -> Column:
    return F.col("remote").isin(REMOTE, HYBRID) if include_hybrid else F.col("remote") == REMOTE


def posted_within(posted: Column, days: int, as_of: Column, include_undated: bool = False) -> Column:
    """Posted on or after ``as_of - days``; unreadable dates pass only when asked for."""
    day = parse_date(posted, as_of)
    return F.coalesce(day >= F.date_sub(as_of, days), F.lit(include_undated))


def location_any(terms: list[str]) -> Column:
    place = F.lower(text_or_empty(F.col("location")))
    wanted = [t for t in terms if t.strip()]
    hit = F.lit(not wanted)
    for t in wanted:
        hit = hit | place.contains(t.lower())
    return hit


def domain_pred(url: Column, allow: list[str] | tuple = (), deny: list[str] | tuple = ()) -> Column:
    ok = F.lit(not allow)
    for d in allow:
        ok = ok | U.on_domain(url, d)
    for d in deny:
        ok = ok & ~U.on_domain(url, d)
    return ok


def html_only(pages: DataFrame) -> DataFrame:
    """Pages that are HTML; a missing content type counts as HTML."""
    return pages.where(F.coalesce(F.col("content_type").contains("html"), F.lit(True)))


def domain_table_filter(df: DataFrame, domains: DataFrame, deny: bool = False) -> DataFrame:
    """Keep (or drop) rows whose host is in, or under, a domain of the ``domains`` table.

    Hosts are reduced to one row each, however popular, and their parent domains exploded beside them, so the
    suffix test becomes an equality join of two narrow tables.
    """
    hosts = df.select(U.host(F.col("url")).alias("host")).distinct()
    names = hosts.select("host", F.explode(U.host_suffixes(F.concat(F.lit("//"), F.col("host")))).alias("domain"))
    listed = domains.select(U.domain_column(F.col("domain")).alias("domain")).where("domain <> ''")
    hit = names.join(listed, "domain", "left_semi").select(F.col("host").alias("_host")).distinct()
    hit = cut(hit, "domain-hosts")  # its size decides whether the rows have to move
    return df.join(hit, U.host(F.col("url")) == F.col("_host"), "left_anti" if deny else "left_semi")


_SEPARATORS = rf"(?U)[{WS}-]+"


ROW_LOCAL_TERMS = 20_000  # entries of a term table that are handed to every task; longer tables are joined
_BUCKETS = 4096


def _prepared_terms(terms: DataFrame) -> DataFrame:
    """``key, term, pattern``: each term under every word that its occurrences can start with.

    Occurrences may run the words of a term together, but only from one separator of the term to the next: ``help desk lead``
    starts with ``help``, ``helpdesk`` or ``helpdesklead``.  The words up to the term's first other character decide; a
    term without any word character stands under the empty key and is tried on every text.
    """
    parts = F.filter(F.split(F.trim("term"), _SEPARATORS), lambda w: w != "")
    parts = F.transform(parts, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    lead = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    # The look-behind stands after the first word, so that it is tried where the word was found, not everywhere.
    pattern = F.concat(
        F.lit("(?iU)"), lead, F.lit(r"(?<!\w"), lead, F.lit(")"),
        F.array_join(F.transform(F.slice(parts, 2, 1 << 20), lambda w: F.concat(F.lit(r"[\s-]*"), w)), ""), F.lit(r"(?!\w)"),
    )
    groups = F.transform(
        F.split(fold_case(F.trim("term")), rf"(?U)[^\w{WS}-]+"),
        lambda g: F.filter(F.split(g, _SEPARATORS), lambda w: w != ""),
    )
    first = F.coalesce(F.get(F.filter(groups, lambda g: F.size(g) > 0), F.lit(0)), F.array().cast("array<string>"))
    starts = F.when(F.size(first) == 0, F.array(F.lit(""))).otherwise(
        F.transform(first, lambda _, i: F.array_join(F.slice(first, F.lit(1), i + 1), "")))
    listed = terms.where(F.trim("term") != "").select("term").distinct()
    return listed.select(F.explode(starts).alias("key"), "term", pattern.alias("pattern"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(fold_case(text), r"(?U)\W+")))


def term_matches(df: DataFrame, terms: DataFrame, text: Column, id_col: str = "posting_id") -> DataFrame:
    """``(id, term)`` for every term of a table that occurs in a row's text.

    The distinct words of a text are looked up among the words that terms start with, and only the terms found there are
    tried on the text, so that a row gives no more than its hits, however many words a term has.  Up to ``ROW_LOCAL_TERMS``
    entries the look-up is a hashed table inside the row's own expression and nothing is moved; a longer table is joined by
    word, and the texts by the rows that hold such a word.
    """
    listed = cut(_prepared_terms(terms), "terms")
    rows = df.select(F.col(id_col), text.alias("text"))
    if listed.limit(ROW_LOCAL_TERMS + 1).count() > ROW_LOCAL_TERMS:
        return _joined_terms(rows, listed, id_col)
    bucket = F.pmod(F.xxhash64("key"), F.lit(_BUCKETS)).cast("int")
    entries = listed.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct("key", "term", "pattern")).alias("entries"))
    every = listed.sparkSession.range(_BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(entries, "bucket", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "entries"))), lambda b: b["entries"]).alias("t")).scalar()

    def hits(row: Column) -> Column:
        def of(w: Column) -> Column:
            return F.get(row["table"], F.pmod(F.xxhash64(w), F.lit(_BUCKETS)).cast("int"))

        # Nearly all words fall into empty places of the table and are passed over first.
        likely = F.filter(_words(row["text"]), lambda w: of(w).isNotNull())
        tried = F.flatten(F.transform(likely, lambda w: F.filter(of(w), lambda e: e["key"] == w)))
        return F.array_distinct(F.transform(F.filter(tried, lambda e: F.rlike(row["text"], e["pattern"])), lambda e: e["term"]))

    # The table is a value computed once; it is named in one place, so that no row carries a copy of it.
    return unnest(rows.withColumn("table", table), [id_col], let(F.struct("text", "table"), hits), "term").drop("_pos")


def _joined_terms(rows: DataFrame, listed: DataFrame, id_col: str) -> DataFrame:
    found = unnest(rows, [id_col], _words(F.col("text")), "key")
    # Stored for its size, which decides how the texts are joined to it.
    tried = cut(found.join(listed, "key").select(id_col, "term", "pattern").distinct(), "term-hits")
    return tried.join(rows, id_col).where(F.rlike("text", F.col("pattern"))).select(id_col, "term").distinct()
