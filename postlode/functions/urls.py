"""URL functions: hosts, link resolution, dedupe keys and routing to a provider."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules
from .core import first_filled, let, text_or_empty, trim_ws

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def with_scheme(value: Column) -> Column:
    return F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))


def host(value: Column) -> Column:
    """Lower-cased host of an absolute or scheme-relative URL; empty when it has none."""
    return F.lower(
        F.regexp_extract(
            value, r"^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1
        )
    )


def scheme(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, _SCHEME, 1))


def path(value: Column) -> Column:
    return F.regexp_extract(value, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def origin(value: Column) -> Column:
    """Scheme and network location, as a robots file is addressed."""
    return F.regexp_extract(value, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


def bare_host(value: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(value), r"^www\.", "")


def url_key(value: Column) -> Column:
    """Key under which two URLs count as one posting; NULL for an empty URL."""
    return F.nullif(F.lower(F.rtrim(text_or_empty(value), F.lit("/"))), F.lit(""))


def drop_fragment(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)#.*", "")


def _without_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(acc: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(segment == ".", acc)
            .otherwise(F.concat(acc, F.array(segment)))
        )

    resolved = F.array_join(
        F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/"
    )
    resolved = F.when(p.rlike(r"/\.\.?$"), F.concat(resolved, F.lit("/"))).otherwise(resolved)
    resolved = F.when(resolved.startswith("/"), resolved).otherwise(F.concat(F.lit("/"), resolved))
    return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), resolved).otherwise(p)


def join_url(base: Column, ref: Column) -> Column:
    """Absolute URL of a link found on ``base``."""

    def absolute(r: Column) -> Column:
        own_scheme = scheme(r)
        base_origin = origin(base)
        base_path = path(base)
        base_dir = F.regexp_replace(base_path, r"[^/]*\z", "")
        ref_path = F.regexp_extract(r, r"^([^?#]*)", 1)
        tail = F.substring(r, F.length(ref_path) + 1, F.length(r))
        merged = F.when(ref_path.startswith("/"), ref_path).otherwise(
            F.regexp_replace(
                F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), ref_path), r"(?<=/)/+", ""
            )
        )
        return (
            F.when(r == "", base)
            .when(own_scheme != "", F.concat(own_scheme, F.substring(r, F.length(own_scheme) + 1, F.length(r))))
            .when(r.startswith("//"), F.concat(scheme(base), F.lit(":"), r))
            .when(r.startswith("?"), F.concat(base_origin, base_path, r))
            .when(r.startswith("#"), F.concat(drop_fragment(base), r))
            .otherwise(F.concat(base_origin, _without_dots(merged), tail))
        )

    clean = F.regexp_replace(text_or_empty(ref), r"^[\x00-\x20]+|[\t\r\n]", "")
    return let(clean, absolute)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute URL of a link found on ``base``, without its fragment."""
    return drop_fragment(join_url(base, ref))


def is_job_link(url: Column, pattern: str = rules.JOB_LINK) -> Column:
    return path(url).rlike(pattern)


def normalize_domain(domain: str) -> str:
    """Plain domain of an allow or deny entry given as a domain or URL."""
    import re

    text = domain.strip().lower()
    if "://" in text:
        text = re.sub(r"^[^:]*://(?:[^/?#]*@)?([^:/?#]*).*$", r"\1", text, flags=re.S)
    return re.sub(r"^www\.", "", text.strip("."))


def domain_column(value: Column) -> Column:
    """``normalize_domain`` for a column of domains."""
    low = F.lower(trim_ws(value))
    low = F.when(low.contains("://"), host(low)).otherwise(low)
    return F.regexp_replace(F.btrim(low, F.lit(".")), r"^www\.", "")


def on_domain(url: Column, domain: str) -> Column:
    """Is the host of ``url`` the domain or one of its subdomains?"""
    d = normalize_domain(domain)
    if not d:
        return F.lit(False)
    h = host(url)
    return (h == d) | h.endswith("." + d)


def host_suffixes(url: Column) -> Column:
    """The host and all its parent domains, for equality joins against a domain list."""
    labels = F.split(host(url), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def route(url: Column) -> Column:
    """Provider behind a site or URL.

    Struct of ``provider``, ``board``, ``source`` (the name its postings carry) and ``start_urls`` for crawled
    sites.  NULL for a blank entry, a URL that is not http(s), or a Workday address without a career site.
    """
    cleaned = trim_ws(text_or_empty(url))

    def build(full: Column) -> Column:
        h = host(full)
        bare = F.regexp_replace(h, r"^www\.", "")
        parts = F.filter(F.split(path(full), "/"), lambda s: s != "")
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        asked = F.regexp_extract(full, r"^[^#]*?[?&]for=([^&#]+)", 1)
        asked = F.coalesce(F.try_url_decode(asked), asked)
        board = first_filled(asked, F.when(first != "embed", first).otherwise(""))
        located = F.when(first.rlike(r"^[a-z]{2}(?:-[A-Z]{2})?$"), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
        site = F.when(~F.coalesce(located, F.lit("")).isin("", "job", "details"), located)
        tenant = F.regexp_extract(h, r"^([^.]*)", 1)

        def answer(provider, board_name, source, starts=None) -> Column:
            starts = F.array().cast("array<string>") if starts is None else starts
            return F.struct(
                (F.lit(provider) if isinstance(provider, str) else provider).alias("provider"),
                board_name.alias("board"),
                source.alias("source"),
                starts.alias("start_urls"),
            )

        def on(domain: str) -> Column:
            return (h == domain) | h.endswith("." + domain)

        blank = F.lit("")
        root = origin(full)
        none = F.lit(None).cast("struct<provider:string,board:string,source:string,start_urls:array<string>>")
        choice = F.when((full == "https://") | ~scheme(full).isin("http", "https") | (h == ""), none)
        choice = choice.when(
            h.endswith(".myworkdayjobs.com"),
            F.when(
                site.isNotNull(),
                answer("workday", F.concat(h, F.lit("/"), site),
                       F.concat(F.lit("workday:"), tenant, F.lit("/"), site)),
            ),
        )
        choice = choice.when(
            on("greenhouse.io") & (board != ""), answer("greenhouse", board, F.concat(F.lit("greenhouse:"), board))
        )
        choice = choice.when(
            on("lever.co") & (first != "") & (h != "api.lever.co"),
            answer("lever", first, F.concat(F.lit("lever:"), first)),
        )
        for name, domain, _ in rules.SOURCES:
            match = (bare == domain) | bare.endswith("." + domain) if name == "linkedin" else bare == domain
            starts = rules.SITE_PRESETS.get(name)
            choice = choice.when(
                match,
                answer("site" if starts else name, blank, F.lit(name),
                       F.array(*map(F.lit, starts)) if starts else None),
            )
        guesses = F.array(*[F.concat(root, F.lit(p)) for p in rules.CAREER_PATHS])
        return choice.otherwise(
            answer("site", blank, h, F.when(F.size(parts) == 0, guesses).otherwise(F.array(full)))
        )

    return F.when(cleaned != "", let(with_scheme(cleaned), build))


def linkedin_job_id(urn: Column, href: Column) -> Column:
    return first_filled(
        F.regexp_extract(urn, r"jobPosting:(\d+)", 1),
        F.regexp_extract(href, r"(?:-|/view/)(\d{6,})(?:[/?]|$)", 1),
    )
