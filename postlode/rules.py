"""Rule catalogues used by the detectors, filters and page readers.

Everything between the two "fixed values" markers is vocabulary: word lists, patterns, tables and limits whose
exact content decides the result of a search.  All patterns are Java regular expressions; ``(?U)`` makes ``\\w``,
``\\s`` and ``\\b`` Unicode-aware whatever the JDK.
"""

from __future__ import annotations

import re

# ------------------------------------------------------------------ fixed values
# Search terms per field.
FIELD_TERMS = {
    "cybersecurity": [
        "cybersecurity", "cyber security", "cyber", "information security", "infosec", "security engineer",
        "security analyst", "security architect", "SOC", "SOC analyst", "security operations", "penetration tester",
        "penetration testing", "pentest", "application security", "appsec", "network security", "cloud security",
        "incident response", "threat intelligence", "vulnerability management", "GRC", "DevSecOps",
    ],
    "software-engineering": [
        "software engineer", "software developer", "backend", "back-end", "frontend", "front-end",
        "full stack", "fullstack", "web developer", "mobile developer",
    ],
    "data": [
        "data scientist", "data science", "data engineer", "data analyst", "machine learning", "ML engineer",
        "analytics engineer", "business intelligence",
    ],
    "devops": [
        "devops", "site reliability", "SRE", "platform engineer", "infrastructure engineer", "cloud engineer",
        "kubernetes",
    ],
    "it-support": [
        "IT support", "help desk", "helpdesk", "service desk", "desktop support", "system administrator",
        "sysadmin", "technical support",
    ],
}

# Named boards: (name, domain, searched by default).
SOURCES = [
    ("remoteok", "remoteok.com", True),
    ("remotive", "remotive.com", True),
    ("arbeitnow", "arbeitnow.com", True),
    ("ninjajobs", "ninjajobs.org", False),
    ("linkedin", "linkedin.com", False),
]
SITE_PRESETS = {"ninjajobs": ["https://ninjajobs.org/jobs", "https://ninjajobs.org/"]}
LINKEDIN_SEARCH = "https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search"
LINKEDIN_DETAIL = "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"
CAREER_PATHS = ["/", "/careers", "/jobs"]

# Limits.
SUMMARY_CHARS = 300
MAX_REQUIREMENTS = 15
REQUIREMENT_CHARS = 300
MAX_EXPERIENCE = 3
RAW_TEXT_CHARS = 120
HEADING_CHARS = 80
MIN_PAGE_TEXT = 100
LINKS_PER_PAGE = 50
LISTING_LINKS = 3
CRAWL_PAGES = 25
CRAWL_DEPTH = 2
WORKDAY_PAGE_SIZE = 20
MAX_CELL = 32767

# Work arrangement.
NOT_REMOTE = r"(?iU)\b(?:not|no|non)[- ]remote\b|\bon[- ]?site only\b|\bin[- ]office only\b"
HYBRID_WORD = r"(?iU)\bhybrid\b"
REMOTE_SHORT = r"(?iU)\bremote\b|\banywhere\b|\bwork from home\b|\bwfh\b|\btelecommut"
REMOTE_LONG = (
    r"(?iU)\b(?:fully|100%|completely|full[- ]time)\s+remote\b"
    r"|\bremote[- ](?:first|friendly|position|role|job|opportunity|work(?:ing)?|eligible|option)\b"
    r"|\b(?:position|role|job) is remote\b"
    r"|\bwork(?:ing)? (?:from home|remotely)\b"
    r"|\btelecommut"
)
ONSITE_WORDS = r"(?iU)\bon[- ]?site\b|\bin[- ]office\b|\bin[- ]person\b"
LEVER_WORKPLACE = {"remote": "Remote", "hybrid": "Hybrid", "onsite": "On-site", "on-site": "On-site"}

# Education, highest level first.
EDUCATION = [
    ("Doctorate", r"(?iU)\bph\.?\s?d\b|\bdoctorate\b|\bdoctoral degree\b"),
    ("Master's", r"(?iU)\bmaster(?:['’]?s)?\s+(?:degree|of|in)\b|\bmasters?['’]? degree\b|\bmba\b"
                 r"|\bm\.s\.(?=[\s,;)])|\bmsc\b"),
    ("Bachelor's", r"(?iU)\bbachelor(?:['’]?s)?\b|\bb\.[sa]\.(?=[\s,;)])|\bbsc\b|\bundergraduate degree\b"
                   r"|\b4[- ]year degree\b"),
    ("Associate's", r"(?iU)\bassociate(?:['’]?s)?\s+degree\b|\b2[- ]year degree\b"),
    ("High school diploma/GED", r"(?U)\bhigh school (?:diploma|degree|education)\b|\bGED\b"),
]
GENERIC_DEGREE = (
    r"(?iU)\b(?:college|university|academic) degree\b|\bdegree (?:in|required)\b"
    r"|\b(?:relevant|related|technical) degree\b"
)
GENERIC_DEGREE_LABEL = "Degree (level unspecified)"
EQUIVALENT = (
    r"(?iU)\bor equivalent (?:\w+ ){0,2}experience\b|\bequivalent (?:combination|experience)\b"
    r"|\bin lieu of (?:a )?degree\b"
)
EQUIVALENT_SUFFIX = " (or equivalent experience)"

# Certifications in catalogue order.
CERTIFICATIONS = [
    ("CISSP", r"(?U)\bCISSP\b"),
    ("CISM", r"(?U)\bCISM\b"),
    ("CISA", r"(?U)\bCISA\b"),
    ("CRISC", r"(?U)\bCRISC\b"),
    ("CGEIT", r"(?U)\bCGEIT\b"),
    ("CCSP", r"(?U)\bCCSP\b"),
    ("SSCP", r"(?U)\bSSCP\b"),
    ("CSSLP", r"(?U)\bCSSLP\b"),
    ("CCSK", r"(?U)\bCCSK\b"),
    ("CDPSE", r"(?U)\bCDPSE\b"),
    ("CIPP", r"(?U)\bCIPP\b"),
    ("CEH", r"(?U)\bC\|?EH\b|(?i:\bcertified ethical hacker\b)"),
    ("CHFI", r"(?U)\bCHFI\b"),
    ("OSCP", r"(?U)\bOSCP\b"),
    ("OSCE", r"(?U)\bOSCE3?\b"),
    ("OSWE", r"(?U)\bOSWE\b"),
    ("OSEP", r"(?U)\bOSEP\b"),
    ("GIAC", r"(?U)\bGIAC\b"),
    ("GSEC", r"(?U)\bGSEC\b"),
    ("GCIH", r"(?U)\bGCIH\b"),
    ("GCIA", r"(?U)\bGCIA\b"),
    ("GPEN", r"(?U)\bGPEN\b"),
    ("GCFA", r"(?U)\bGCFA\b"),
    ("GCFE", r"(?U)\bGCFE\b"),
    ("GREM", r"(?U)\bGREM\b"),
    ("GWAPT", r"(?U)\bGWAPT\b"),
    ("GXPN", r"(?U)\bGXPN\b"),
    ("GICSP", r"(?U)\bGICSP\b"),
    ("CompTIA Security+", r"(?iU)\bsec(?:urity)?\s?\+"),
    ("CompTIA Network+", r"(?iU)\bnet(?:work)?\s?\+"),
    ("CompTIA A+", r"(?U)(?<![\w+])A\+(?![\w+])"),
    ("CompTIA CySA+", r"(?U)\bCySA\b"),
    ("CompTIA PenTest+", r"(?iU)\bpentest\s?\+"),
    ("CompTIA CASP+", r"(?U)\bCASP\b"),
    ("CompTIA Linux+", r"(?iU)\blinux\s?\+"),
    ("CompTIA Cloud+", r"(?iU)\bcloud\s?\+"),
    ("CCNA", r"(?U)\bCCNA\b"),
    ("CCNP", r"(?U)\bCCNP\b"),
    ("CCIE", r"(?U)\bCCIE\b"),
    ("AWS Certification", r"(?U)\bAWS[- ](?i:certifi(?:ed|cation))"),
    ("Azure Certification", r"(?U)\bAZ-\d{3}\b|\bAzure (?i:certifi(?:ed|cation))"),
    ("Google Cloud Certification", r"(?U)\b(?:Google Cloud|GCP) (?i:professional|certifi(?:ed|cation))"),
    ("CKA", r"(?U)\bCKA\b"),
    ("CKAD", r"(?U)\bCKAD\b"),
    ("CKS", r"(?U)\bCKS\b"),
    ("RHCSA", r"(?U)\bRHCSA\b"),
    ("RHCE", r"(?U)\bRHCE\b"),
    ("PMP", r"(?U)\bPMP\b"),
    ("Certified ScrumMaster", r"(?U)\bCSM\b|(?i:\bcertified scrum ?master\b)"),
    ("ITIL", r"(?U)\bITIL\b"),
    ("CPA", r"(?U)\bCPA\b"),
    ("Six Sigma", r"(?iU)\bsix sigma\b"),
    ("DoD 8570/8140", r"(?U)\b(?:DoDD? ?)?8570\b|\b(?:DoDD? ?)8140\b|\b8140\.0?3\b"),
    ("ISO 27001 Auditor/Implementer", r"(?U)\bISO\s?27001 (?i:(?:lead )?(?:auditor|implementer))"),
]

# Lower-case pieces of text without which a rule cannot match; they are looked for before its pattern is tried.
# A rule that is one bounded word needs no entry.
NEEDS = {
    "Doctorate": ["ph", "doctor"], "Master's": ["master", "mba", "m.s.", "msc"],
    "Bachelor's": ["bachelor", "b.s.", "b.a.", "bsc", "undergraduate", "year degree"], "Associate's": ["associate", "year degree"],
    "High school diploma/GED": ["high school", "ged"],
    "CEH": ["ceh", "c|eh", "ethical hacker"], "OSCE": ["osce"], "CompTIA Security+": ["+"], "CompTIA Network+": ["+"],
    "CompTIA A+": ["a+"], "CompTIA PenTest+": ["pentest"], "CompTIA Linux+": ["linux"], "CompTIA Cloud+": ["cloud"],
    "AWS Certification": ["aws"], "Azure Certification": ["az-", "azure"], "Google Cloud Certification": ["google cloud", "gcp"],
    "Certified ScrumMaster": ["csm", "scrum"], "Six Sigma": ["six sigma"], "DoD 8570/8140": ["8570", "8140"],
    "ISO 27001 Auditor/Implementer": ["27001"],
    "TS/SCI": ["sci"], "Top Secret": ["secret"], "Secret": ["secret"], "Public Trust": ["public trust"], "Polygraph": ["poly"],
}
EQUIVALENT_NEEDS = ["equivalent", "in lieu"]
GENERIC_DEGREE_NEEDS = ["degree"]
GENERIC_CLEARANCE_NEEDS = ["clearance"]
EXPERIENCE_NEEDS = ["exp"]
NOT_REMOTE_NEEDS = ["remote", "only"]
REMOTE_LONG_NEEDS = ["remote", "work", "telecommut"]

# Clearances.
CLEARANCES = [
    ("TS/SCI", r"(?U)\bTS\s*/\s*SCI\b"),
    ("Top Secret", r"(?iU)\btop[- ]secret\b"),
    ("Secret", r"(?iU)(?<!top )(?<!top-)\bsecret (?:security )?clearance\b"),
    ("Public Trust", r"(?iU)\bpublic trust\b"),
    ("Polygraph", r"(?iU)\bpolygraph\b|\b(?:full[- ]scope|CI) poly\b"),
]
GENERIC_CLEARANCE = (
    r"(?iU)\b(?:security|active|government|federal|dod) clearance\b|\bclearance (?:is )?required\b"
    r"|\bability to obtain (?:and maintain )?(?:a )?clearance\b"
)
GENERIC_CLEARANCE_LABEL = "Security clearance"

# Years of experience: lower bound, open-ended mark, upper bound.
EXPERIENCE = (
    r"(?iU)\b(\d{1,2})\s*(\+|plus)?\s*(?:(?:-|–|—|to)\s*(\d{1,2})\s*\+?\s*)?"
    r"(?:years?|yrs?)['’]?\s+(?:of\s+)?(?:[\w/&,+.-]+\s+){0,5}?(?:experience|exp)\b"
)

# Section headings and requirement cues.
REQUIREMENT_HEADING = (
    r"(?iU)^\W*(?:(?:minimum|basic|required|preferred|key|desired|technical|essential|job|candidate|position)\s+){0,2}"
    r"(?:requirements?|qualifications?|skills?(?:\s+(?:and|&)\s+(?:experience|qualifications))?"
    r"|experience\s+(?:and|&)\s+(?:skills|qualifications)|education(?:\s+(?:and|&)\s+experience)?"
    r"|what\s+you['’]?ll\s+need|what\s+you\s+(?:need|bring|have)|what\s+we['’]?re\s+looking\s+for"
    r"|who\s+you\s+are|about\s+you|must[- ]haves?|you\s+(?:have|should\s+have|will\s+need)|your\s+profile"
    r"|the\s+ideal\s+candidate)\W*$"
)
OTHER_HEADING = (
    r"(?iU)^\W*(?:benefits?|perks|what\s+we\s+offer|compensation|salary|pay\b|about\b|(?:key\s+|your\s+)?responsibilities"
    r"|what\s+you['’]?ll\s+do|duties|the\s+role|role\s+overview|how\s+to\s+apply|equal\s+(?:employment\s+)?opportunity"
    r"|why\b|our\b|nice[- ]to[- ]haves?|bonus|job\s+description|overview|who\s+we\s+are|location|apply)"
)
REQUIREMENT_CUE = (
    r"(?iU)\b(?:required|requirements?|must (?:have|be|possess)|degree|certifi(?:ed|cation)|clearance"
    r"|years?['’]? (?:of )?(?:\w+ )?experience|proficien(?:t|cy)|experience (?:with|in))\b"
)
BULLETS = " \t•·*-–—"
SUMMARY_TAIL = " ,;:-"
ELLIPSIS = "…"

# Dates.
ISO_DATE = r"(?U)\b(\d{4})-(\d{2})-(\d{2})"
TODAY_WORDS = r"(?U)\b(?:today|just (?:now|posted))\b"
RELATIVE_DATE = r"(?U)\b(\d+)\+?\s*(minute|min|hour|hr|day|week|wk|month|mo)s?\b\s*ago"
UNIT_DAYS = {"minute": 0, "min": 0, "hour": 0, "hr": 0, "day": 1, "week": 7, "wk": 7, "month": 30, "mo": 30}
POSTED_PREFIX = r"(?iU)^(?:posted|published|date posted)\s*(?:on)?:?\s*"
ORDINAL = r"(?U)(\d)(?:st|nd|rd|th)\b"
EMBEDDED_DATE = (
    r"(?U)\b[A-Z][a-z]{2,8} \d{1,2},? \d{4}\b|\b\d{1,2} [A-Z][a-z]{2,8},? \d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"
)
POSTED_PHRASE = r"(?iU)\b(?:posted|published)\b[^\n]{0,40}"

# Pages.
BLOCK_TAGS = [
    "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6",
    "tr", "table", "section", "article", "header", "footer", "blockquote", "pre",
]
PAGE_CHROME = ["nav", "header", "footer", "form", "noscript"]
JOB_LINK = (
    r"(?iU)/(?:jobs?|careers?|positions?|openings?|vacanc(?:y|ies)|postings?|opportunit(?:y|ies)|requisitions?)"
    r"(?:[/_?-]|$)"
)
CONTAINER_NAME = r"(?:job|posting)[-_]?(?:description|details|body|content)"
TITLE_SEPARATOR = r"(?U)\s+[|–—-]\s+"
POSTED_META = ["article:published_time", "datePosted", "date"]
BOARD_HOSTS = r"(?i)(?:^|\.)(?:myworkdayjobs\.com|greenhouse\.io|lever\.co)$"
TEXT_KEYS = ["credentialCategory", "name", "description", "value"]
ADDRESS_KEYS = ["addressLocality", "addressRegion", "addressCountry"]

# Sheet output.
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".xlsx": "xlsx", ".json": "json"}
LIST_SEPARATORS = {"requirements": " | "}
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FORMULA_START = r"^ *[=+\-@\t\r]"
# ------------------------------------------------------------------ end of fixed values

_EXTRA: dict[str, list[tuple[str, str]]] = {"education": [], "certifications": [], "clearance": []}
_EXTRA_TERMS: dict[str, list[str]] = {}


def catalogue(kind: str) -> list[tuple[str, str]]:
    """Built-in rules of ``kind`` followed by the registered ones, in output order."""
    built_in = {"education": EDUCATION, "certifications": CERTIFICATIONS, "clearance": CLEARANCES}
    return built_in[kind] + _EXTRA[kind]


def register_rules(kind: str, rules: list[tuple[str, str]]) -> None:
    """Append ``(label, java_regex)`` rules to a detector catalogue, or terms to a search field.

    ``kind`` is ``education``, ``certifications``, ``clearance`` or ``field:<name>``; for a field the rules are
    plain terms.  Rules become literals in the plan, so register them before building a query.
    """
    if kind.startswith("field:"):
        _EXTRA_TERMS.setdefault(kind[len("field:"):], []).extend(rules)
    elif kind in _EXTRA:
        _EXTRA[kind].extend(rules)
    else:
        raise KeyError(f"Unknown rule kind {kind!r}; choose from: {', '.join(_EXTRA)}, field:<name>")


def field_terms() -> dict[str, list[str]]:
    """Search terms per field, registered ones included."""
    merged = {name: list(terms) for name, terms in FIELD_TERMS.items()}
    for name, terms in _EXTRA_TERMS.items():
        merged.setdefault(name, []).extend(terms)
    return merged


def expand_fields(names: list[str]) -> list[str]:
    """Search terms of the named fields, in order and without repeats."""
    known = field_terms()
    picked: dict[str, None] = {}
    for name in names:
        key = re.sub(r"[ _]", "-", name.strip().lower())
        if key not in known:
            raise KeyError(f"No search field called {name!r}; known fields: {', '.join(known)}")
        picked.update(dict.fromkeys(known[key]))
    return list(picked)


def term_pattern(term: str) -> str:
    """Whole-word, case-insensitive pattern in which space and hyphen runs of ``term`` match any run or none."""
    words = [re.escape(w) for w in re.split(r"[\s-]+", term.strip()) if w]
    if not words:
        return r"(?iU)(?<!\w)(?!\w)"
    # The look-behind stands after the first word, so that it is tried where the word was found, not everywhere.
    first = words[0]
    return rf"(?iU){first}(?<!\w{first})" + "".join(rf"[\s-]*{w}" for w in words[1:]) + r"(?!\w)"
