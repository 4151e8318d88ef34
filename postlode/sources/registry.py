"""Source selection and the plug-in point for further providers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rules
from . import boards

Normalizer = Callable[[DataFrame, Column], DataFrame]

_NORMALIZERS: dict[str, Normalizer] = {
    "remoteok": lambda raw, as_of: boards.normalize_remoteok(raw),
    "remotive": lambda raw, as_of: boards.normalize_remotive(raw),
    "arbeitnow": lambda raw, as_of: boards.normalize_arbeitnow(raw),
    "greenhouse": lambda raw, as_of: boards.normalize_greenhouse(raw),
    "lever": lambda raw, as_of: boards.normalize_lever(raw),
    "workday": lambda raw, as_of: boards.normalize_workday(raw, as_of),
}
_DOMAINS: dict[str, str] = {}


def register_normalizer(name: str, domain: str, fn: Normalizer) -> None:
    """Add a provider: ``fn(raw, as_of)`` turns its landed payloads into postings."""
    _NORMALIZERS[name] = fn
    _DOMAINS[name] = domain


def _known() -> list[tuple[str, str, bool]]:
    return rules.SOURCES + [(n, d, False) for n, d in _DOMAINS.items()]


def sources_table(spark: SparkSession) -> DataFrame:
    """Known named sources with their domain and whether they are searched by default."""
    return spark.createDataFrame(_known(), "name STRING, domain STRING, is_default BOOLEAN")


def field_terms_table(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t) for f, terms in rules.field_terms().items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "field STRING, ord INT, term STRING")


def resolve_names(names: list[str]) -> list[str]:
    """Source names behind names, domains or URLs, first mention kept; ``all`` stands for every known one.

    An empty list means the default sources.  An unknown name is an error before anything runs.
    """
    known = _known()
    if not names:
        return [n for n, _, default in known if default]
    picked: dict[str, None] = {}
    for given in names:
        text = given.strip().lower()
        if text == "all":
            picked.update((n, None) for n, _, _ in known)
            continue
        text = re.sub(r"^www\.", "", re.sub(r"^[a-z][a-z0-9+.\-]*://([^/:?#]*).*$", r"\1", text))
        match = next((n for n, d, _ in known if text in (n, d)), None)
        if match is None:
            raise KeyError(f"No source called {given!r}; known sources: {', '.join(n for n, _, _ in known)}")
        picked[match] = None
    return list(picked)


def select_sources(raw: DataFrame, names: list[str] | None = None, boards_of: dict[str, list[str]] | None = None) -> DataFrame:
    """Payloads of the chosen sources with their ``source_rank``.

    ``names`` are named sources; ``boards_of`` lists board tokens per multi-board provider.  Both come from the
    caller, so they are literals in the plan: the predicate reaches the Parquet scan and no join is made.
    """
    wanted: list[tuple[str, str | None]] = []
    if names or not boards_of:
        wanted += [(n, None) for n in resolve_names(names or [])]
    paged = [n for n, _ in wanted if n not in _NORMALIZERS]
    if paged:
        raise ValueError(f"Read from pages, not from payloads: {', '.join(paged)}; give them to plans.sites.search_sites")
    for provider in ("greenhouse", "lever", "workday"):
        wanted += [(provider, b) for b in dict.fromkeys((boards_of or {}).get(provider, []))]
    rank = F.lit(None).cast("int")
    keep = F.lit(False)
    for i, (provider, board) in reversed(list(enumerate(wanted))):
        hit = F.col("provider").isin(provider, provider + "_detail") if provider == "workday" \
            else F.col("provider") == provider
        if board is not None:
            hit = hit & (F.col("board") == board)
        rank = F.when(hit, i).otherwise(rank)
        keep = keep | hit
    return raw.where(keep).withColumn("source_rank", rank)


def providers_in(raw: DataFrame) -> list[str]:
    """The registered providers that have payloads in ``raw``; as many as there are kinds of them at most."""
    present = {r["provider"] for r in raw.select("provider").distinct().collect()}
    return [name for name in _NORMALIZERS if name in present]


def normalize(raw: DataFrame, as_of: Column, providers: list[str] | None = None) -> DataFrame:
    """Postings of every provider in ``raw``, keeping the order given by ``source_rank``."""
    out = None
    for name in providers or list(_NORMALIZERS):
        df = _NORMALIZERS[name](raw, as_of)
        out = df if out is None else out.unionByName(df)
    return out
