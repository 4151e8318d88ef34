"""Text mining of descriptions: headings, requirement lines and summaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules
from .core import WS, at_least_words, empty_array, let, split_lines, text_or_empty, trim_chars, trim_ws

_SENTENCE_GAP = rf"(?U)(?<=[.!?])[{WS}]+"


def is_heading(line: Column) -> Column:
    """Short line that ends in a colon, or has at most six words and no full stop."""
    return (F.length(line) <= rules.HEADING_CHARS) & (
        line.endswith(":") | (~line.endswith(".") & ~at_least_words(line, 7))
    )


def heading_kind(line: Column) -> Column:
    """``req``, ``other`` or NULL.  A line such as "About you" is both; the requirement reading wins."""
    return F.when(
        is_heading(line),
        F.when(line.rlike(rules.REQUIREMENT_HEADING), "req").when(line.rlike(rules.OTHER_HEADING), "other"),
    )


def _append_capped(items: Column, line: Column) -> Column:
    """Add the line, cut to its cap, unless the list is full or already holds the full line."""
    full = (F.size(items) >= rules.MAX_REQUIREMENTS) | F.array_contains(items, line)
    return F.when(full, items).otherwise(
        F.concat(items, F.array(F.substring(line, 1, rules.REQUIREMENT_CHARS)))
    )


def section_requirements(text: Column) -> Column:
    """Lines below a requirements heading, up to the next known heading."""
    lines = F.filter(
        F.transform(split_lines(text), lambda x: trim_chars(x, rules.BULLETS)), lambda x: x != ""
    )
    start = F.struct(F.lit(False).alias("inside"), empty_array().alias("items"))

    def step(acc: Column, line: Column) -> Column:
        return let(
            heading_kind(line),
            lambda kind: F.when(kind == "req", F.struct(F.lit(True).alias("inside"), acc["items"].alias("items")))
            .when(kind == "other", F.struct(F.lit(False).alias("inside"), acc["items"].alias("items")))
            .when(
                acc["inside"],
                F.struct(acc["inside"].alias("inside"), _append_capped(acc["items"], line).alias("items")),
            )
            .otherwise(acc),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["items"])


def cue_requirements(text: Column) -> Column:
    """Sentences that carry a requirement cue word, for texts without a requirements section."""
    sentences = F.transform(
        F.split(text, _SENTENCE_GAP + r"|\n"), lambda x: trim_chars(x, rules.BULLETS)
    )
    cued = F.filter(sentences, lambda x: (x != "") & x.rlike(rules.REQUIREMENT_CUE))
    return F.when(
        text.rlike(rules.REQUIREMENT_CUE), F.aggregate(cued, empty_array(), _append_capped)
    ).otherwise(empty_array())


def extract_requirements(text: Column) -> Column:
    text = text_or_empty(text)
    return let(
        section_requirements(text),
        lambda items: F.when(F.size(items) > 0, items).otherwise(cue_requirements(text)),
    )


def summarize(text: Column, max_chars: int = rules.SUMMARY_CHARS) -> Column:
    """Whole sentences of the introduction up to ``max_chars``; a cut sentence when the first is too long."""
    text = text_or_empty(text)

    def intro(lines: Column) -> Column:
        wordy = F.transform(lines, lambda x: at_least_words(x, 4))
        return let(F.array_position(wordy, True).cast("int"), lambda first: body_from(lines, first))

    def body_from(lines: Column, first: Column) -> Column:
        later = F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0)))
        stop = F.array_position(F.transform(later, lambda x: heading_kind(x).isNotNull()), True).cast("int")
        kept = let(
            stop,
            lambda s: F.slice(lines, first, F.when(s > 0, s).otherwise(F.size(lines) - first + 1)),
        )
        words = F.filter(F.split(text, rf"(?U)[{WS}]+"), lambda x: x != "")
        return F.when(
            first > 0, F.array_join(F.filter(kept, lambda x: at_least_words(x, 4)), " ")
        ).otherwise(F.array_join(words, " "))

    def shorten(body: Column) -> Column:
        def fill(acc: Column, sentence: Column) -> Column:
            length = acc["chars"] + F.length(sentence) + F.when(acc["n"] > 0, 1).otherwise(0)
            fits = ~acc["done"] & (length <= max_chars)
            return F.struct(
                F.when(fits, length).otherwise(acc["chars"]).alias("chars"),
                F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                (~fits).alias("done"),
            )

        start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        whole = let(
            F.split(trim_ws(body), _SENTENCE_GAP),
            lambda s: F.array_join(F.slice(s, F.lit(1), F.aggregate(s, start, fill, lambda a: a["n"])), " "),
        )
        cut = F.regexp_replace(F.substring(body, 1, max_chars), r"(?s) [^ ]*\z", "")
        return F.when(body == "", "").otherwise(
            let(
                whole,
                lambda w: F.when(w != "", w).otherwise(
                    F.concat(F.rtrim(cut, F.lit(rules.SUMMARY_TAIL)), F.lit(rules.ELLIPSIS))
                ),
            )
        )

    return let(let(split_lines(text), intro), shorten)
