import html
import random
import re

from postlode.functions.html import collapse_lines, element, html_to_text, html_unescape, inline_text, json_ld, strip_hidden
from postlode.functions.text import extract_requirements, summarize

PAGE = """<div><p>Orbit Labs needs a <i>Detection Lead</i> for its platform&nbsp;group. You will tune rules
daily. The team is small.</p><h2>What you will do</h2><ul><li>Tune rules</li></ul>
<h3>Your profile:</h3><ul><li>Master's degree in IT</li><li>• 4+ years of SIEM experience</li><li>Master's degree in IT</li></ul>
<h3>Perks</h3><p>Free fruit</p></div>"""


def test_entities_match_the_html_standard(apply):
    rng = random.Random(3)
    parts = ["&amp;", "&amp", "&lt;b&gt;", "&copy", "&notin;", "&notit;", "&bogus;", "&#65;", "&#x1F600;", "&#0;", "&#128;",
             "&#xD800;", "&#99999999;", "&;", "&", " x ", "&&", "&NotEqualTilde;", "é", "&#x;", "&#;", "&amp;lt;", "&Tab;", "&#xFFFE;", "&#013;"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    assert apply(lambda a, *_: html_unescape(a), rows) == [html.unescape(r) for r in rows]


def test_html_to_text(apply):
    rows = [
        PAGE,
        "a<br>b<BR/>c",
        "x <!-- <p>no</p> --> y<script>if (a<b) '</p>'</script>z<style>p{}</style>",
        '<a title="1 > 0" href=x>link</a> 3 < 4 & 5 > 2',
        "<td>one</td><td>two</td>",
        None,
        "<script>never closed <p>x</p>",
        "one two\x0bthree \t  four",
    ]
    got = apply(lambda a, *_: html_to_text(a), rows)
    assert got[0].split("\n")[:3] == [
        "Orbit Labs needs a Detection Lead for its platform group. You will tune rules", "daily. The team is small.", "What you will do"]
    assert got[1:] == ["a\nb\nc", "x yz", "link 3 < 4 & 5 > 2", "onetwo", "", "", "one\ntwo\nthree four"]


def test_elements_are_balanced(apply):
    page = '<div id=a>1<div class="box job-description"><div>2</div><p>3</p></div><div>4</div></div>'
    from postlode.functions.html import attr_matches, has_class

    assert apply(lambda a, *_: element(a, attr_matches("class", "job-description")), [page]) == ["<div>2</div><p>3</p>"]
    assert apply(lambda a, *_: element(a, has_class("box")), [page]) == ["<div>2</div><p>3</p>"]
    assert apply(lambda a, *_: element(a, has_class("bo")), [page]) == [""]
    assert apply(lambda a, *_: inline_text(a), ["<b> x </b>&nbsp;<i>y</i> z"]) == ["x y z"]


def test_json_ld_scripts(apply):
    page = ("<!-- <script type='application/ld+json'>0</script> --><script>1</script>"
            "<SCRIPT id=x type=\"application/ld+json\">2</SCRIPT><script type=application/ld+json>3</script>"
            "<script type='application/ld+json+x'>4</script>")
    assert apply(lambda a, *_: json_ld(a), [page, "plain"]) == [["2", "3"], []]
    assert apply(lambda a, *_: strip_hidden(a), ["a<!-- <script> -->b<script>c --></script>d"]) == ["abd"]


def test_requirements_section_and_caps(apply):
    long = "word " * 80
    rows = [
        "Intro line\nRequirements\n- One\n* Two\n- One\nBenefits\nFree lunch\nAbout you\n– Three",
        "\n".join(["Qualifications:"] + [f"- item {i}" for i in range(20)]),
        f"Skills\n{long}\n{long}\nshort",
        "We build. A degree in IT is required. Snacks! Must have 2 years of Go experience.",
        "nothing of interest here",
        "",
    ]
    got = apply(lambda a, *_: extract_requirements(a), rows)
    assert got[0] == ["One", "Two", "Three"]
    assert got[1] == [f"item {i}" for i in range(15)]
    # A full line is compared with cut ones, so repeats beyond the cap stay.
    assert got[2] == [long.strip()[:300], long.strip()[:300], "short"]
    assert got[3] == ["A degree in IT is required.", "Must have 2 years of Go experience."]
    assert got[4] == [] and got[5] == []


def test_summary(apply):
    rows = [
        "About the role\nWe guard a very large cloud. You will write rules. " + "More text follows here. " * 20,
        "word " * 100,
        "Short intro of four words.\nRequirements\nA long line that must not be part of it.",
        "one two\nthree",
        "",
    ]
    got = apply(lambda a, *_: summarize(a, 60), rows)
    assert got[0] == "We guard a very large cloud. You will write rules."
    assert got[1].endswith("…") and len(got[1]) <= 61 and got[1] == ("word " * 12).strip() [:59] + "…"
    assert got[2] == "Short intro of four words."
    assert got[3] == "one two three"
    assert got[4] == ""


def test_white_space_of_every_kind_is_collapsed(apply):
    rng = random.Random(11)
    breaks, blanks = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "\t\x1f\xa0\u1680\u2000\u200a\u202f\u205f\u3000"
    kinds = [[" ", "\n", "w", "\u200b", "\u180e"], [" ", "w", *breaks, *blanks]]
    texts = ["".join(rng.choices(kinds[n % 2], k=rng.randrange(12))) for n in range(600)]

    def collapsed(text):
        text = re.sub(f"[{blanks} ]+", " ", text)
        return re.sub(f" ?[{breaks}][{breaks} ]*", "\n", text).strip(" \n")

    assert apply(lambda v, *_: collapse_lines(v), texts) == [collapsed(t) for t in texts]


def test_texts_of_plain_references_alone(apply):
    rng = random.Random(12)
    parts = ["&amp;", "&lt;", "&gt;", "&quot;", "&#x27;", "&#39;", "lt;", "amp;", "#39;", "x", ";", " "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(300)] + ["&amp;amp;lt;", "&amp;#39;", "&AMP;lt;", "&lt&gt;"]
    assert apply(lambda v, *_: html_unescape(v), texts) == [html.unescape(t) for t in texts]
