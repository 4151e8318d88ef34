"""HTML as Column expressions: text, entities, attributes, elements and links.

Pages are read with regular expressions that run inside the JVM next to the scan.  ``balanced`` finds the end of
an element by counting its own tag, so nested elements are kept whole.
"""

from __future__ import annotations

import html as _entities
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from .. import rules
from .core import BREAKS, WS, apply_sql, first_filled, let, sql_text, text_or_empty, trim_ws

# The rest of a tag after its name: values in quotes may contain '>'.
_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_TAG = r"(?s)<(?:/?[a-zA-Z]|[!?])" + _REST
_BLOCK = r"(?is)</?(?:" + "|".join(rules.BLOCK_TAGS + ["br"]) + r")(?![\w-])" + _REST
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# All white space but space and line feed: that below U+0100, and a range that holds the rest.
_LOW_SPACE, _HIGH_SPACE = r"[\t\x0b-\r\x1c-\x1f\x85\xa0]", r"[\x{1680}-\x{3000}]"
# References that stand in nearly every escaped text; '&' comes last, so that what it makes is not read again.
_PLAIN = {"lt;": "<", "gt;": ">", "quot;": '"', "#x27;": "'", "#39;": "'", "amp;": "&"}
# References that lead the table, because a look-up reads it from the front.
_FREQUENT = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "ndash;",
             "mdash;", "bull;", "middot;", "hellip;", "copy;", "reg;", "trade;"]


@lru_cache(maxsize=1)
def _references() -> str:
    """Every named reference, and every number that does not stand for its own code point, as one text.

    Entries read ``\x01key\x02value``.  A text literal is far cheaper for the optimizer to carry around than a map
    with two thousand entries.
    """
    numbers = [*range(0xA0), *range(0xFDD0, 0xFDF0)]
    numbers += [plane * 0x10000 + low for plane in range(17) for low in (0xFFFE, 0xFFFF)]
    odd = {f"#{n}": _entities.unescape(f"&#{n};") for n in numbers}
    table = {name: html5[name] for name in _FREQUENT} | html5
    table |= {k: v for k, v in odd.items() if v != chr(int(k[1:]))}
    return "".join(f"\x01{k}\x02{v}" for k, v in table.items()) + "\x01"


@lru_cache(maxsize=1)
def _unescape_lambda() -> str:
    """The decoder as SQL: what follows each ampersand is a reference, a known name without semicolon, or text.

    A text that holds no references but the plain ones, as an escaped text does, is decoded by replacing those.
    """
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)

    def find(key: str) -> str:
        return f"""transform(array(position(concat('\x01', {key}, '\x02'), tbl)), at ->
            CASE WHEN at > 0 THEN substring_index(substr(tbl, at + length({key}) + 2, 3), '\x01', 1) END)[0]"""

    number = f"""transform(array(regexp_extract(ref, '^#[xX]?0*([0-9a-fA-F]*)', 1)), digits ->
        transform(array(CASE WHEN length(digits) > 7 THEN 1114112
            ELSE cast(conv(concat('0', digits), CASE WHEN ref rlike '^#[xX]' THEN 16 ELSE 10 END, 10) AS int) END), n ->
          CASE WHEN n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '\ufffd'
            ELSE coalesce({find("concat('#', n)")}, decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')) END)[0])[0]"""
    piece = f"""transform(array(regexp_extract(p, {sql_text(_REFERENCE)}, 1)), ref ->
        transform(array(CASE WHEN startswith(ref, '#') THEN {number} ELSE {find("ref")} END), found ->
          CASE WHEN found IS NOT NULL THEN concat(found, substr(p, length(ref) + 1))
            ELSE transform(array(regexp_extract(ref, {sql_text("^(" + "|".join(legacy) + ")")}, 1)), name ->
              coalesce(concat({find("name")}, substr(p, length(name) + 1)), concat('&', p)))[0] END)[0])[0]"""
    plain = "v"
    for ref, char in _PLAIN.items():
        plain = f"replace({plain}, '&{ref}', {sql_text(char)})"
    odd = sql_text(f"&(?!{'|'.join(_PLAIN)})")
    return f"""v -> CASE WHEN NOT contains(v, '&') THEN v WHEN NOT v rlike {odd} THEN {plain} WHEN contains(v, '&') THEN transform(array({sql_text(_references())}), tbl ->
        array_join(transform(split(v, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {piece} END), ''))[0] ELSE v END"""


def html_unescape(value: Column) -> Column:
    """Decode character references once, left to right.  Text without ``&`` is passed through untouched."""
    return apply_sql(value, _unescape_lambda())


def html_escape(value: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(char), F.lit(ref))
    return value


def strip_hidden(value: Column) -> Column:
    """Remove comments, scripts and styles, whichever opens first winning."""
    return let(value, lambda v: F.when(v.contains("<"), F.regexp_replace(v, _HIDDEN, "")).otherwise(v))


def collapse_lines(value: Column) -> Column:
    """One space between words, one line break between lines, nothing at the ends."""

    def plain(v: Column) -> Column:
        return F.regexp_replace(F.when(v.contains("  "), F.regexp_replace(v, "  +", " ")).otherwise(v), "\n[\n ]*", "\n")

    def general(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(v, rf"(?U)[[{WS}]&&[^{BREAKS}]]+", " "), rf"[{BREAKS}][{BREAKS} ]*", "\n")

    # Classes of characters from all over Unicode are slow to test; most texts hold spaces and line feeds alone.
    value = let(value, lambda v: F.when(v.rlike(_LOW_SPACE) | v.rlike(_HIGH_SPACE), general(v)).otherwise(plain(v)))
    # At most one space is left before a break.
    return F.btrim(F.replace(value, F.lit(" \n"), F.lit("\n")), F.lit(" \n"))


def visible_text(value: Column) -> Column:
    """Text of markup whose hidden parts are already gone."""

    def untagged(v: Column) -> Column:
        stripped = F.regexp_replace(F.regexp_replace(v, _BLOCK, "\n"), _TAG, "")
        return F.when(v.contains("<"), stripped).otherwise(v)

    return collapse_lines(html_unescape(let(value, untagged)))


def html_to_text(value: Column) -> Column:
    """Plain text with one line per block element."""
    return visible_text(strip_hidden(text_or_empty(value)))


def pieces_text(marked: Column) -> Column:
    """Text whose pieces are separated by ``\x01``: each stripped, joined by one space."""
    pieces = F.transform(F.split(marked, "\x01"), trim_ws)
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def mark_pieces(fragment: Column) -> Column:
    """Markup with every tag replaced by the piece separator."""
    return F.regexp_replace(fragment, _TAG, "\x01")


def inline_text(fragment: Column) -> Column:
    """Text pieces of a fragment, each stripped, joined by one space."""
    return pieces_text(html_unescape(mark_pieces(fragment)))


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one opening tag as written; empty when absent."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""^["']|["']\z""", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute with its character references decoded."""
    return html_unescape(raw_attribute(tag, name))


def opening_tag(value: Column, condition: str) -> Column:
    """First opening tag matching ``condition`` with everything after it; empty when there is none."""
    return F.regexp_extract(value, r"(?is)<" + condition + ".*", 0)


def balanced(from_tag: Column) -> Column:
    """Inner markup of the element whose opening tag starts ``from_tag``."""

    def cut_at(pieces: Column) -> Column:
        steps = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end")),
            lambda acc, p: let(
                acc["depth"] + F.when(p.startswith("</"), -1).otherwise(1),
                lambda depth: F.struct(
                    depth.alias("depth"),
                    (acc["seen"] + 1).alias("seen"),
                    F.when((acc["end"] == 0) & (depth == 0), acc["seen"]).otherwise(acc["end"]).alias("end"),
                ),
            ),
            lambda acc: F.when(acc["end"] == 0, acc["seen"]).otherwise(acc["end"]),
        )
        return F.array_join(F.slice(pieces, F.lit(1), steps), "")

    def inner(tag: Column) -> Column:
        name = F.regexp_extract(tag, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1)
        pieces = F.split(tag, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"(?![\w-]))")))
        return F.when(tag == "", "").otherwise(
            F.regexp_replace(let(pieces, cut_at), r"(?s)\A<[a-zA-Z]" + _REST, "")
        )

    return let(from_tag, inner)


def element(value: Column, condition: str) -> Column:
    """Inner markup of the first element whose opening tag matches ``condition``."""
    return let(opening_tag(value, condition), balanced)


def has_class(name: str) -> str:
    """Tag condition: the class list contains ``name``."""
    return _attr_condition("class", rf"(?:[^\"'>]*\s)?{name}(?=[\s\"'>])[^\"'>]*")


def attr_matches(attr: str, pattern: str) -> str:
    """Tag condition: the value of ``attr`` contains ``pattern``."""
    return _attr_condition(attr, rf"[^\"'>]*{pattern}[^\"'>]*")


def _attr_condition(attr: str, value: str) -> str:
    return rf"""[a-z][a-z0-9]*\b[^>]*?[\s"'/]{attr}\s*=\s*["']?{value}["']?"""


@lru_cache(maxsize=4)
def _drop_lambda(names: str) -> str:
    """A fold over the markup cut before every opening or closing tag of the named elements.

    ``open`` holds the names of the elements that are open, the innermost first.  A closing tag ends the innermost element
    of its name and whatever is open inside it; without such an element it is passed over.
    """
    tag = f"(?i)(?=</?(?:{names})(?![\\w-]))"
    name = f"lower(regexp_extract(p, {sql_text(f'(?i)^</?({names})(?![' + chr(92) + 'w-])')}, 1))"
    after = f"regexp_replace(p, {sql_text(r'(?s)' + chr(92) + 'A</?[a-zA-Z]+' + _REST)}, '')"
    closed = "slice(acc.open, array_position(acc.open, n) + 1, size(acc.open))"
    alone = f"p rlike {sql_text(r'(?s)' + chr(92) + 'A<[^>]*/>')}"
    step = f"""CASE
        WHEN n = '' THEN named_struct('open', acc.open, 'kept', concat(acc.kept, CASE WHEN size(acc.open) = 0 THEN array(p) ELSE array() END))
        WHEN startswith(p, '</') OR {alone} THEN transform(array(CASE WHEN startswith(p, '</') AND array_contains(acc.open, n) THEN {closed} ELSE acc.open END), left ->
          named_struct('open', left, 'kept', concat(acc.kept, CASE WHEN size(left) = 0 THEN array({after}) ELSE array() END)))[0]
        ELSE named_struct('open', concat(array(n), acc.open), 'kept', acc.kept) END"""
    zero = "named_struct('open', cast(array() AS array<string>), 'kept', cast(array() AS array<string>))"
    fold = f"aggregate(pieces, {zero}, (acc, p) -> transform(array({name}), n -> {step})[0], acc -> array_join(acc.kept, ''))"
    return f"v -> transform(array(split(v, {sql_text(tag)})), pieces -> CASE WHEN size(pieces) = 1 THEN v ELSE {fold} END)[0]"


def drop_elements(value: Column, names: list[str]) -> Column:
    """Remove whole elements at any depth; one that is never closed runs to the end of its parent among them, or of the page."""
    return apply_sql(value, _drop_lambda("|".join(names)))


def json_ld(page: Column) -> Column:
    """Contents of every ``application/ld+json`` script outside comments, in page order."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"), F.lit(0))
    typed = F.filter(
        found, lambda s: s.rlike(r"""(?i)\A<script\b[^>]*?\stype\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json[\s>])""")
    )
    body = F.transform(typed, lambda s: F.regexp_replace(s, r"(?is)\A<script\b[^>]*>|</script\s*>\z", ""))
    return F.when(page.contains("ld+json"), body).otherwise(F.array().cast("array<string>"))


def references(value: Column, names: list[str]) -> Column:
    """``href`` (else ``src``) of the named elements in page order.  Script tags count, their text does not."""
    shown = F.regexp_replace(
        value, r"(?is)<!--.*?(?:-->|\z)|(<(script|style)\b[^>]*>).*?(?:</\2\s*>|\z)", "$1"
    )
    tags = F.regexp_extract_all(shown, F.lit(rf"(?is)<(?:{'|'.join(names)})(?![\w-]){_REST}"), F.lit(0))
    refs = F.transform(tags, lambda t: first_filled(attribute(t, "href"), attribute(t, "src")))
    return F.filter(refs, lambda r: r != "")


def anchors(value: Column) -> Column:
    """``href`` values of ``a`` elements that carry one, in page order."""
    tags = F.regexp_extract_all(strip_hidden(value), F.lit(rf"(?is)<a(?![\w-])(?=[^>]*?[\s\"'/]href\s*=){_REST}"), F.lit(0))
    return F.transform(tags, lambda t: attribute(t, "href"))


def meta_tags(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"(?is)<meta(?![\w-])" + _REST), F.lit(0))


def meta(tags: Column, names: list[str]) -> Column:
    """First filled ``content`` over ``names``, undecoded; a tag found by ``property`` hides one found by ``name``."""

    def content(name: Column) -> Column:
        def having(attr: str) -> Column:
            lead = rf"""(?is)[\s"'/]{attr}\s*=\s*["']?"""
            quoted = F.concat(F.lit(lead), name, F.lit(r"""(?=["'\s/>])"""))
            return F.get(F.filter(tags, lambda t: F.rlike(t, quoted)), F.lit(0))

        return trim_ws(raw_attribute(F.coalesce(having("property"), having("name"), F.lit("")), "content"))

    contents = F.transform(F.array(*map(F.lit, names)), content)
    return F.coalesce(F.get(F.filter(contents, lambda c: c != ""), F.lit(0)), F.lit(""))
