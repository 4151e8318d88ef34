"""Detectors: work arrangement, education, certifications, experience, clearance."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import rules
from ..schema import HYBRID, ONSITE, REMOTE, UNKNOWN
from .core import fold_case, holds_any, let, text_or_empty


def detect_remote(title: Column, location: Column, description: Column, tags: Column) -> Column:
    """Remote / Hybrid / On-site / Unknown.  Loose words count in the short fields, strong phrases in the text."""
    short = F.concat_ws(" ", text_or_empty(title), text_or_empty(location), text_or_empty(F.array_join(tags, " ")))
    text = text_or_empty(description)

    def classify(v: Column) -> Column:
        hybrid = v["short"].rlike(rules.HYBRID_WORD)
        denied = v["short"].rlike(rules.NOT_REMOTE) | (
            holds_any(v["folded"], rules.NOT_REMOTE_NEEDS) & v["text"].rlike(rules.NOT_REMOTE)
        )
        remote = v["short"].rlike(rules.REMOTE_SHORT) | (
            holds_any(v["folded"], rules.REMOTE_LONG_NEEDS) & v["text"].rlike(rules.REMOTE_LONG)
        )
        # A denial with the word hybrid beside it means hybrid, so the word alone settles both cases.
        return (
            F.when(hybrid, HYBRID).when(denied, ONSITE).when(remote, REMOTE)
            .when(v["short"].rlike(rules.ONSITE_WORDS), ONSITE).otherwise(UNKNOWN)
        )

    return let(F.struct(short.alias("short"), text.alias("text"), fold_case(text).alias("folded")), classify)


def map_workplace(value: Column, provider: str) -> Column:
    """Work arrangement from a provider's own label."""
    label = F.lower(text_or_empty(value))
    if provider == "lever":
        mapped = F.lit(None).cast("string")
        for key, meaning in rules.LEVER_WORKPLACE.items():
            mapped = F.when(label == key, meaning).otherwise(mapped)
        return F.coalesce(mapped, F.lit(UNKNOWN))
    return (
        F.when(label.contains("hybrid"), HYBRID)
        .when(label.contains("remote"), REMOTE)
        .when(label.contains("site") | label.contains("office"), ONSITE)
        .otherwise(UNKNOWN)
    )


def _rule_hits(texts: Column, kind: str) -> Column:
    """Labels of the matching rules; ``texts`` holds the text and its case-folded form.

    Patterns are tried only on texts that contain a piece they cannot match without.  Most rules are absent from
    most texts, so nearly all of the work is byte searches.
    """
    text, folded = texts["text"], texts["folded"]

    def hit(label: str, pattern: str) -> Column:
        word = re.fullmatch(r"\(\?U\)\\b(\w+)\\b", pattern)
        if word:
            return text.contains(word.group(1)) & text.rlike(pattern)
        needs = rules.NEEDS.get(label)
        return holds_any(folded, needs) & text.rlike(pattern) if needs else text.rlike(pattern)

    return F.array_compact(F.array(*[F.when(hit(n, p), n) for n, p in rules.catalogue(kind)]))


def _with_folded(text: Column, body) -> Column:
    both = lambda t: F.struct(t.alias("text"), fold_case(t).alias("folded"))
    return let(let(text_or_empty(text), both), body)


def detect_education(text: Column) -> Column:
    def read(texts: Column) -> Column:
        t, folded = texts["text"], texts["folded"]
        equal = holds_any(folded, rules.EQUIVALENT_NEEDS) & t.rlike(rules.EQUIVALENT)
        suffix = F.when(equal, rules.EQUIVALENT_SUFFIX).otherwise("")
        generic = holds_any(folded, rules.GENERIC_DEGREE_NEEDS) & t.rlike(rules.GENERIC_DEGREE)
        return let(
            _rule_hits(texts, "education"),
            lambda found: F.when(F.size(found) > 0, F.concat(F.array_join(found, ", "), suffix))
            .when(generic, F.concat(F.lit(rules.GENERIC_DEGREE_LABEL), suffix))
            .otherwise(""),
        )

    return _with_folded(text, read)


def detect_certifications(text: Column) -> Column:
    return _with_folded(text, lambda texts: _rule_hits(texts, "certifications"))


def detect_clearance(text: Column) -> Column:
    def read(texts: Column) -> Column:
        generic = holds_any(texts["folded"], rules.GENERIC_CLEARANCE_NEEDS) & texts["text"].rlike(rules.GENERIC_CLEARANCE)
        return let(
            _rule_hits(texts, "clearance"),
            lambda found: F.when((F.size(found) == 0) & generic, F.array(F.lit(rules.GENERIC_CLEARANCE_LABEL)))
            .otherwise(found),
        )

    return _with_folded(text, read)


def detect_experience(text: Column) -> Column:
    """Up to three distinct demands such as ``3+ years; 2-4 years``."""

    def number(match: Column, group: int) -> Column:
        digits = F.regexp_extract(match, rules.EXPERIENCE, group)
        return F.coalesce(digits.try_cast("int").cast("string"), digits)

    def render(match: Column) -> Column:
        high = number(match, 3)
        plus = F.when(F.regexp_extract(match, rules.EXPERIENCE, 2) != "", "+").otherwise("")
        return F.concat(
            number(match, 1), F.when(high != "", F.concat(F.lit("-"), high)).otherwise(plus), F.lit(" years")
        )

    def read(texts: Column) -> Column:
        matches = F.regexp_extract_all(texts["text"], F.lit(rules.EXPERIENCE), F.lit(0))
        demands = F.array_distinct(F.transform(matches, render))
        joined = F.array_join(F.slice(demands, 1, rules.MAX_EXPERIENCE), "; ")
        return F.when(holds_any(texts["folded"], rules.EXPERIENCE_NEEDS), joined).otherwise("")

    return _with_folded(text, read)
