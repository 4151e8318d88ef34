"""The driver queries in SQL for DuckDB.

DuckDB's patterns know no look-around and treat ``\\b`` and ``\\w`` as ASCII, so word edges are written as one
consumed character (``L`` before, ``R`` after) that is no letter, digit or underscore, or an end of the text.
"""

from __future__ import annotations

from .views import AS_OF, BOARD_SITE_PAGES, BROKEN_BOARD, BROKEN_FROM, FAULTY, FIRST_SITE, MANY_SITE_PAGES, MORE_LINKS, POSTINGS, SITE_PAGES

L = r"(?:^|[^\p{L}\p{N}_])"
R = r"(?:$|[^\p{L}\p{N}_])"
S = r"[\s\x{00A0}]"
WITH = f"WITH p AS ({POSTINGS})"
TODAY = f"DATE '{AS_OF}'"
SEARCH_TEXT = "(title || chr(10) || array_to_string(tags, ' ') || chr(10) || description)"

# ---------------------------------------------------------------- fixed values, written for this pattern dialect
CYBER = ["cybersecurity", "cyber security", "cyber", "information security", "infosec", "security engineer",
         "security analyst", "security architect", "SOC", "SOC analyst", "security operations", "penetration tester",
         "penetration testing", "pentest", "application security", "appsec", "network security", "cloud security",
         "incident response", "threat intelligence", "vulnerability management", "GRC", "DevSecOps"]
SOFTWARE = ["software engineer", "software developer", "backend", "back-end", "frontend", "front-end", "full stack",
            "fullstack", "web developer", "mobile developer"]
DATA = ["data scientist", "data science", "data engineer", "data analyst", "machine learning", "ML engineer",
        "analytics engineer", "business intelligence"]
DEVOPS = ["devops", "site reliability", "SRE", "platform engineer", "infrastructure engineer", "cloud engineer", "kubernetes"]
SUPPORT = ["IT support", "help desk", "helpdesk", "service desk", "desktop support", "system administrator", "sysadmin",
           "technical support"]
TERMS = ["part-time", "VPN", "Security+", "B.S.", "TS/SCI", "full  time", "help desk lead", "remote - us", "+", "degree"]

EDUCATION = [
    ("Doctorate", [L + r"ph\.?\s?d" + R, L + "doctorate" + R, L + "doctoral degree" + R]),
    ("Master's", [L + r"master(?:['’]?s)?\s+(?:degree|of|in)" + R, L + r"masters?['’]? degree" + R, L + "mba" + R,
                  L + r"m\.s\.[\s,;)]", L + "msc" + R]),
    ("Bachelor's", [L + r"bachelor(?:['’]?s)?" + R, L + r"b\.[sa]\.[\s,;)]", L + "bsc" + R, L + "undergraduate degree" + R,
                    L + "4[- ]year degree" + R]),
    ("Associate's", [L + r"associate(?:['’]?s)?\s+degree" + R, L + "2[- ]year degree" + R]),
]
SCHOOL = [L + "high school (?:diploma|degree|education)" + R, L + "GED" + R]
GENERIC_DEGREE = [L + "(?:college|university|academic) degree" + R, L + "degree (?:in|required)" + R,
                  L + "(?:relevant|related|technical) degree" + R]
EQUIVALENT = [L + r"or equivalent (?:[\p{L}\p{N}_]+ ){0,2}experience" + R, L + "equivalent (?:combination|experience)" + R,
              L + "in lieu of (?:a )?degree" + R]
ACRONYMS_1 = ["CISSP", "CISM", "CISA", "CRISC", "CGEIT", "CCSP", "SSCP", "CSSLP", "CCSK", "CDPSE", "CIPP"]
ACRONYMS_2 = ["GIAC", "GSEC", "GCIH", "GCIA", "GPEN", "GCFA", "GCFE", "GREM", "GWAPT", "GXPN", "GICSP"]
CERTS = (
    [(a, L + a + R) for a in ACRONYMS_1]
    + [("CEH", L + r"C\|?EH" + R + "|" + L + "(?i:certified ethical hacker)" + R)]
    + [(a, L + a + R) for a in ("CHFI", "OSCP")] + [("OSCE", L + "OSCE3?" + R)] + [(a, L + a + R) for a in ("OSWE", "OSEP")]
    + [(a, L + a + R) for a in ACRONYMS_2]
    + [("CompTIA Security+", "(?i)" + L + r"sec(?:urity)?\s?\+"), ("CompTIA Network+", "(?i)" + L + r"net(?:work)?\s?\+"),
       ("CompTIA A+", r"(?:^|[^\p{L}\p{N}_+])A\+(?:$|[^\p{L}\p{N}_+])"), ("CompTIA CySA+", L + "CySA" + R),
       ("CompTIA PenTest+", "(?i)" + L + r"pentest\s?\+"), ("CompTIA CASP+", L + "CASP" + R),
       ("CompTIA Linux+", "(?i)" + L + r"linux\s?\+"), ("CompTIA Cloud+", "(?i)" + L + r"cloud\s?\+")]
    + [(a, L + a + R) for a in ("CCNA", "CCNP", "CCIE")]
    + [("AWS Certification", L + r"AWS[- ](?i:certifi(?:ed|cation))"),
       ("Azure Certification", L + r"AZ-[0-9]{3}" + R + "|" + L + "Azure (?i:certifi(?:ed|cation))"),
       ("Google Cloud Certification", L + "(?:Google Cloud|GCP) (?i:professional|certifi(?:ed|cation))")]
    + [(a, L + a + R) for a in ("CKA", "CKAD", "CKS", "RHCSA", "RHCE", "PMP")]
    + [("Certified ScrumMaster", L + "CSM" + R + "|" + L + "(?i:certified scrum ?master)" + R)]
    + [(a, L + a + R) for a in ("ITIL", "CPA")]
    + [("Six Sigma", "(?i)" + L + "six sigma" + R),
       ("DoD 8570/8140", L + "(?:DoDD? ?)?8570" + R + "|" + L + "DoDD? ?8140" + R + "|" + L + r"8140\.0?3" + R),
       ("ISO 27001 Auditor/Implementer", L + r"ISO\s?27001 (?i:(?:lead )?(?:auditor|implementer))")]
)
GENERIC_CLEARANCE = [L + "(?:security|active|government|federal|dod) clearance" + R, L + "clearance (?:is )?required" + R,
                     L + "ability to obtain (?:and maintain )?(?:a )?clearance" + R]
NOT_REMOTE = [L + "(?:not|no|non)[- ]remote" + R, L + "on[- ]?site only" + R, L + "in[- ]office only" + R]
REMOTE_SHORT = [L + "remote" + R, L + "anywhere" + R, L + "work from home" + R, L + "wfh" + R, L + "telecommut"]
REMOTE_LONG = [L + r"(?:fully|100%|completely|full[- ]time)\s+remote" + R,
               L + "remote[- ](?:first|friendly|position|role|job|opportunity|work(?:ing)?|eligible|option)" + R,
               L + "(?:position|role|job) is remote" + R, L + "work(?:ing)? (?:from home|remotely)" + R, L + "telecommut"]
ONSITE = [L + "on[- ]?site" + R, L + "in[- ]office" + R, L + "in[- ]person" + R]
EXPERIENCE = (r"(?i)\b([0-9]{1,2})\s*(\+|plus)?\s*(?:(?:-|–|—|to)\s*([0-9]{1,2})\s*\+?\s*)?(?:years?|yrs?)['’]?\s+(?:of\s+)?"
              r"(?:[\p{L}\p{N}_/&,+.-]+\s+){0,5}?(?:experience|exp)\b")
NW = r"[^\p{L}\p{N}_]*"
REQ_HEADING = (
    f"(?i)^{NW}" + r"(?:(?:minimum|basic|required|preferred|key|desired|technical|essential|job|candidate|position)\s+){0,2}"
    r"(?:requirements?|qualifications?|skills?(?:\s+(?:and|&)\s+(?:experience|qualifications))?|experience\s+(?:and|&)\s+(?:skills|qualifications)"
    r"|education(?:\s+(?:and|&)\s+experience)?|what\s+you['’]?ll\s+need|what\s+you\s+(?:need|bring|have)|what\s+we['’]?re\s+looking\s+for"
    r"|who\s+you\s+are|about\s+you|must[- ]haves?|you\s+(?:have|should\s+have|will\s+need)|your\s+profile|the\s+ideal\s+candidate)" + f"{NW}$"
)
OTHER_HEADING = (
    f"(?i)^{NW}" + r"(?:benefits?|perks|what\s+we\s+offer|compensation|salary|pay" + R + "|about" + R + r"|(?:key\s+|your\s+)?responsibilities"
    r"|what\s+you['’]?ll\s+do|duties|the\s+role|role\s+overview|how\s+to\s+apply|equal\s+(?:employment\s+)?opportunity|why" + R + "|our" + R +
    r"|nice[- ]to[- ]haves?|bonus|job\s+description|overview|who\s+we\s+are|location|apply)"
)
CUE = (
    "(?i)" + L + r"(?:required|requirements?|must (?:have|be|possess)|degree|certifi(?:ed|cation)|clearance|years?['’]? (?:of )?(?:[\p{L}\p{N}_]+ )?experience"
    r"|proficien(?:t|cy)|experience (?:with|in))" + R
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(col: str, patterns: list[str] | str, ci: bool = True) -> str:
    patterns = [patterns] if isinstance(patterns, str) else patterns
    return f"regexp_matches({col}, {q(('(?i)' if ci else '') + '|'.join(patterns))})"


def term(t: str) -> str:
    import re

    words = [re.sub(r"([^A-Za-z0-9])", r"\\\1", w) for w in re.split(r"[\s-]+", t.strip()) if w]
    return L + r"[\s-]*".join(words) + R


def any_term(col: str, terms: list[str]) -> str:
    return hit(col, [term(t) for t in terms])


def labels(col: str, rules: list, ci: bool) -> str:
    cases = ", ".join(f"CASE WHEN {hit(col, p, ci)} THEN {q(n)} END" for n, p in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


# ---------------------------------------------------------------- values
REMOTE = f"""CASE WHEN {hit('short', NOT_REMOTE)} OR {hit('description', NOT_REMOTE)}
    THEN CASE WHEN {hit('short', L + 'hybrid' + R)} THEN 'Hybrid' ELSE 'On-site' END
  WHEN {hit('short', L + 'hybrid' + R)} THEN 'Hybrid'
  WHEN {hit('short', REMOTE_SHORT)} OR {hit('description', REMOTE_LONG)} THEN 'Remote'
  WHEN {hit('short', ONSITE)} THEN 'On-site' ELSE 'Unknown' END"""
SHORT = "(title || ' ' || location || ' ' || array_to_string(tags, ' '))"


def remote(source: str = "p") -> str:
    return f"SELECT *, {REMOTE} AS remote FROM (SELECT *, {SHORT} AS short FROM {source})"


POSTED_ON = f"""CASE WHEN regexp_matches(posted_raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(regexp_extract(posted_raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE)
  WHEN regexp_matches(posted_raw, '(?i)\\btoday\\b') THEN {TODAY} WHEN contains(lower(posted_raw), 'yesterday') THEN {TODAY} - 1
  WHEN regexp_matches(posted_raw, '(?i)[0-9]+\\+?\\s*(day|week)s? ago') THEN {TODAY} - CAST(regexp_extract(posted_raw, '([0-9]+)', 1) AS INT)
    * CASE WHEN contains(posted_raw, 'week') THEN 7 ELSE 1 END
  WHEN posted_raw LIKE '%/%' THEN CAST(try_strptime(posted_raw, '%m/%d/%Y') AS DATE)
  WHEN posted_raw LIKE 'Oct%' THEN CAST(try_strptime(posted_raw, '%b %d, %Y') AS DATE)
  WHEN contains(posted_raw, 'October') THEN CAST(try_strptime(regexp_extract(regexp_replace(posted_raw, '([0-9])st', '\\1'), '[0-9]+ October [0-9]{{4}}'), '%d %B %Y') AS DATE)
  END"""
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1))"


def on_domain(d: str) -> str:
    return f"({HOST} = '{d}' OR {HOST} LIKE '%.{d}')"


EDU = f"""CASE WHEN len(edu) > 0 THEN array_to_string(edu, ', ') || eq WHEN {hit('description', GENERIC_DEGREE)}
  THEN 'Degree (level unspecified)' || eq ELSE '' END"""
EDU_LIST = (labels("description", EDUCATION, True)[:-len("], lambda x: x IS NOT NULL)")]
            + f", CASE WHEN {hit('description', SCHOOL, False)} THEN 'High school diploma/GED' END], lambda x: x IS NOT NULL)")
EQ = f"CASE WHEN {hit('description', EQUIVALENT)} THEN ' (or equivalent experience)' ELSE '' END"


def education(source: str = "p") -> str:
    return f"SELECT *, {EDU} AS education FROM (SELECT *, {EDU_LIST} AS edu, {EQ} AS eq FROM {source})"


CERT_TEXT = f"array_to_string({labels('description', CERTS, False)}, '|')"
SECRET_TEXT = "regexp_replace(description, '(?i)top[ -]secret', 'topX', 'g')"
CLEAR_LIST = f"""list_filter([CASE WHEN {hit('description', L + r'TS\s*/\s*SCI' + R, False)} THEN 'TS/SCI' END,
  CASE WHEN {hit('description', L + 'top[- ]secret' + R)} THEN 'Top Secret' END,
  CASE WHEN {hit(SECRET_TEXT, L + 'secret (?:security )?clearance' + R)} THEN 'Secret' END,
  CASE WHEN {hit('description', L + 'public trust' + R)} THEN 'Public Trust' END,
  CASE WHEN {hit('description', [L + 'polygraph' + R, L + '(?:full[- ]scope|CI) poly' + R])} THEN 'Polygraph' END], lambda x: x IS NOT NULL)"""


def clearance(source: str = "p") -> str:
    return f"""SELECT *, CASE WHEN len(cl) > 0 THEN array_to_string(cl, '|') WHEN {hit('description', GENERIC_CLEARANCE)}
      THEN 'Security clearance' ELSE '' END AS clearance FROM (SELECT *, {CLEAR_LIST} AS cl FROM {source})"""


EXP_ONE = (
    f"list_transform(regexp_extract_all(description, {q(EXPERIENCE)}), lambda m: "
    f"CAST(CAST(regexp_extract(m, {q(EXPERIENCE)}, 1) AS INT) AS VARCHAR) || CASE WHEN regexp_extract(m, {q(EXPERIENCE)}, 3) <> '' "
    f"THEN '-' || CAST(CAST(regexp_extract(m, {q(EXPERIENCE)}, 3) AS INT) AS VARCHAR) WHEN regexp_extract(m, {q(EXPERIENCE)}, 2) <> '' THEN '+' ELSE '' END || ' years')"
)
# First occurrence of each value, in order, at most three.
EXP = f"""(SELECT coalesce(string_agg(v, '; ' ORDER BY i), '') FROM (SELECT v, min(i) AS i FROM (SELECT unnest(xs) AS v, generate_subscripts(xs, 1) AS i)
  GROUP BY v ORDER BY i LIMIT 3))"""


def experience(source: str = "p") -> str:
    return f"SELECT *, {EXP} AS experience FROM (SELECT *, {EXP_ONE} AS xs FROM {source})"


HEADING = r"(length({c}) <= 80 AND ({c} LIKE '%:' OR (NOT {c} LIKE '%.' AND len(regexp_extract_all({c}, '\S+')) <= 6)))"
BULLETS = q(" \t•·*-–—")


def requirements(source: str = "p") -> str:
    """Lines under the last requirement heading, by running window; else cue sentences.  Full lines are compared
    with the cut ones already taken, which only differ beyond 300 characters."""
    heading = HEADING.format(c="line")
    return f"""
    lines AS (SELECT posting_id, i, trim(raw, {BULLETS}) AS line FROM (SELECT posting_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i
      FROM (SELECT posting_id, string_split(description, chr(10)) AS ls FROM {source}))),
    kinds AS (SELECT *, CASE WHEN {heading} AND regexp_matches(line, {q(REQ_HEADING)}) THEN 'req'
      WHEN {heading} AND regexp_matches(line, {q(OTHER_HEADING)}) THEN 'other' END AS kind FROM lines WHERE line <> ''),
    scoped AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY posting_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS scope FROM kinds),
    taken AS (SELECT posting_id, i, line, row_number() OVER (PARTITION BY posting_id, line ORDER BY i) AS copy FROM scoped WHERE kind IS NULL AND scope = 'req'),
    section AS (SELECT posting_id, i, substr(line, 1, 300) AS line, row_number() OVER (PARTITION BY posting_id ORDER BY i) AS n
      FROM taken WHERE copy = 1 OR length(line) > 300),
    sentences AS (SELECT posting_id, i, trim(raw, {BULLETS}) AS line FROM (SELECT posting_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i
      FROM (SELECT posting_id, string_split(regexp_replace(regexp_replace(description, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '([.!?])\\n+', '\\1' || chr(10), 'g'), chr(10)) AS ls FROM {source}))),
    cued AS (SELECT *, row_number() OVER (PARTITION BY posting_id, line ORDER BY i) AS copy FROM sentences WHERE line <> '' AND regexp_matches(line, {q(CUE)})),
    fallback AS (SELECT posting_id, i, substr(line, 1, 300) AS line, row_number() OVER (PARTITION BY posting_id ORDER BY i) AS n
      FROM cued WHERE copy = 1 OR length(line) > 300),
    sect AS (SELECT posting_id, string_agg(line, '|' ORDER BY i) AS r FROM section WHERE n <= 15 GROUP BY posting_id),
    fall AS (SELECT posting_id, string_agg(line, '|' ORDER BY i) AS r FROM fallback WHERE n <= 15 GROUP BY posting_id),
    reqs AS (SELECT posting_id, coalesce(sect.r, fall.r, '') AS requirements FROM {source} LEFT JOIN sect USING (posting_id) LEFT JOIN fall USING (posting_id))"""


def summary(source: str = "p") -> str:
    h = HEADING.format(c="line")
    return f"""
    sl AS (SELECT posting_id, line, i, len(regexp_extract_all(line, '\\S+')) >= 4 AS wordy,
        {h} AND (regexp_matches(line, {q(REQ_HEADING)}) OR regexp_matches(line, {q(OTHER_HEADING)})) AS stop
      FROM (SELECT posting_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT posting_id, string_split(description, chr(10)) AS ls FROM {source}))),
    firsts AS (SELECT posting_id, min(i) AS first FROM sl WHERE wordy GROUP BY posting_id),
    stops AS (SELECT posting_id, min(i) AS stop_at FROM sl JOIN firsts USING (posting_id) WHERE stop AND i > first GROUP BY posting_id),
    bodies AS (SELECT posting_id, string_agg(line, ' ' ORDER BY i) AS body FROM sl LEFT JOIN stops USING (posting_id)
      WHERE wordy AND (stop_at IS NULL OR i < stop_at) GROUP BY posting_id),
    parts AS (SELECT posting_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT posting_id,
      string_split(regexp_replace(trim(body), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM bodies)),
    sized AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY posting_id ORDER BY i) - 1 AS upto FROM parts),
    kept AS (SELECT posting_id, string_agg(s, ' ' ORDER BY i) AS whole FROM sized WHERE upto <= 300 GROUP BY posting_id),
    sums AS (SELECT posting_id, CASE WHEN whole IS NOT NULL THEN whole WHEN body IS NULL THEN ''
      ELSE rtrim(regexp_replace(substr(body, 1, 300), ' [^ ]*$', ''), ' ,;:-') || '…' END AS summary
      FROM {source} LEFT JOIN bodies USING (posting_id) LEFT JOIN kept USING (posting_id))"""


# ---------------------------------------------------------------- duplicates, row by row
DEDUPE = r"""
    keyed AS (SELECT row_number() OVER (ORDER BY seq) AS rn, seq, nullif(lower(rtrim(url, '/')), '') AS u,
        CASE WHEN trim(company) <> '' THEN lower(trim(title)) || '|' || lower(trim(company)) END AS t, source AS s FROM p),
    scan AS (
      SELECT 0::BIGINT AS rn, []::VARCHAR[] AS urls, MAP {}::MAP(VARCHAR, VARCHAR) AS owners, false AS keep, 0::BIGINT AS seq
      UNION ALL
      SELECT rn, CASE WHEN ok AND u IS NOT NULL THEN list_append(urls, u) ELSE urls END,
        CASE WHEN ok AND t IS NOT NULL AND owner IS NULL THEN map_concat(owners, MAP {t: s}) ELSE owners END, ok, seq
      FROM (SELECT k.rn, k.seq, k.u, k.t, k.s, scan.urls, scan.owners, scan.owners[k.t] AS owner,
          (k.u IS NULL OR NOT list_contains(scan.urls, k.u)) AND (k.t IS NULL OR coalesce(scan.owners[k.t], k.s) = k.s) AS ok
        FROM scan JOIN keyed k ON k.rn = scan.rn + 1)),
    uniq AS (SELECT p.* FROM p JOIN scan ON p.seq = scan.seq AND scan.keep)"""

FILTER_EXTRA = f"""remote IN ('Remote', 'Hybrid') AND coalesce(posted_on >= {TODAY} - 14, true)
  AND NOT {on_domain('other.test')} AND {any_term(SEARCH_TEXT, ['help desk'] + CYBER)} AND NOT {any_term(SEARCH_TEXT, ['senior'])}"""


def found(source: str) -> str:
    return f"SELECT * FROM (SELECT *, {POSTED_ON} AS posted_on FROM ({remote(source)})) WHERE {FILTER_EXTRA}"


POSTED_DATE = "coalesce(CAST(posted_on AS VARCHAR), posted_raw)"


def search() -> str:
    inner = education(f"({clearance(f'({experience(chr(40) + found(chr(117) + chr(110) + chr(105) + chr(113)) + chr(41))})')})")
    return f"""WITH RECURSIVE p AS ({POSTINGS}), {DEDUPE}
    SELECT title, company, remote, url, source, {POSTED_DATE} AS posted_date, education, experience, {CERT_TEXT} AS certifications, clearance
    FROM ({inner})"""


def streamed(final: str) -> str:
    """Greenhouse payloads in three runs; what a board gives ends at its first torn payload, in the runs after that too."""
    text = f"{DESC}"
    return f"""
    raw AS (SELECT *, source AS board, posting_id // 10 AS request_no, least((posting_id // 10) * 3 // (SELECT max(posting_id // 10) + 1 FROM base), 2) AS run FROM base),
    torn AS (SELECT min(request_no) AS torn_at FROM raw WHERE board = 's1' AND run = 1 AND request_no % 2 = 1),
    p AS (SELECT posting_id, run * 1000000000000 + CAST(substr(board, 2) AS BIGINT) * 1000000000 + posting_id AS seq, title,
        CASE WHEN company = '' THEN board ELSE company END AS company, location, 'greenhouse:' || board AS source, url, {text} AS description,
        strftime({TODAY} - CAST(posting_id % 30 AS INT), '%Y-%m-%d') AS posted_raw, tags FROM raw, torn WHERE NOT coalesce(board = 's1' AND request_no >= torn_at, false)),
    {final}"""


# ---------------------------------------------------------------- provider payloads
FLAT = ("regexp_replace(regexp_replace(regexp_replace(description, '[ \\t\\r\\x0b\\x0c\\x{00A0}]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), "
        "'^[ \\n]+|[ \\n]+$', '', 'g')")
DESC = f"{FLAT} || chr(10) || 'One' || chr(10) || 'Two & three'"
BOARD = "'board' || CAST((posting_id // 10) % 4 AS VARCHAR)"


def shown(**cols: str) -> str:
    default = dict(title="title", company="company", location="location", remote="'Remote'", url="url", source="source",
                   posted_date="''", employment_type="''", salary="''", tags="array_to_string(tags, '|')", description=DESC)
    default.update(cols)
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in default.items())


def thousands(n: str) -> str:
    return f"format('{{:,}}', {n})"


LO, HI = "(posting_id % 5 * 1000)", "(posting_id % 7 * 25000)"
REMOTEOK_PAY = f"""CASE WHEN {LO} = 0 AND {HI} = 0 THEN '' WHEN {LO} = 0 OR {LO} = {HI} THEN 'USD ' || {thousands(HI)}
  WHEN {HI} = 0 THEN 'USD ' || {thousands(LO)} ELSE 'USD ' || {thousands(LO)} || '-' || {thousands(HI)} END"""
WORKDAY_BOARD = "'acme' || CAST(posting_id // 500 AS VARCHAR)"

# ---------------------------------------------------------------- pages
BLOCKS = "p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|blockquote|pre|br"


def page_text(col: str, chrome: bool = False) -> str:
    out = col
    names = ["script", "style"] + (["nav", "header", "footer", "form", "noscript"] if chrome else [])
    for n in names:
        out = f"regexp_replace({out}, '(?is)<{n}\\b[^>]*>.*?</{n}\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{BLOCKS})\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{char}')"
    out = f"regexp_replace({out}, '[ \\t\\r\\x0b\\x0c\\x{{00A0}}]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({out}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def decoded(col: str) -> str:
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        col = f"replace({col}, '{ref}', '{char}')"
    return col


PAGE_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
LINKS = f"""
  refs AS (SELECT page_id, url, unnest(hs) AS ref, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, url,
      regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)),
  full_refs AS (SELECT page_id, url, i, regexp_replace({PAGE_ORIGIN} || ref, '#.*$', '') AS link FROM refs WHERE ref LIKE '/%'),
  firsts AS (SELECT page_id, link, min(i) AS i FROM full_refs WHERE rtrim(link, '/') <> rtrim(url, '/')
    AND regexp_matches(regexp_replace(substr(link, length({PAGE_ORIGIN}) + 1), '\\?.*$', ''), '/[A-Za-z]') GROUP BY page_id, link),
  ranked AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM firsts)"""

H1 = decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
TITLE_TAG = decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
ARTICLE = "CASE WHEN html LIKE '%<article%' THEN regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) ELSE regexp_extract(html, '(?s)<body[^>]*>(.*)', 1) END"

SITE = "'https://site' || CAST(CASE WHEN {p} % 3 = 0 THEN 0 ELSE {p} % 5 + 1 END AS VARCHAR) || '.example.com'"
ROBOTS = f"""
  s AS ({SITE_PAGES}), o AS (SELECT origin, min(page_id) AS p FROM s GROUP BY origin),
  verdict AS (SELECT s.page_id, s.url, CASE WHEN p = 4 THEN false WHEN p = 5 THEN true
     WHEN p % 3 = 0 THEN NOT (path LIKE '/jobs/2%')
     WHEN p % 3 = 1 THEN (path LIKE '/jobs/11%' OR NOT path LIKE '/jobs/1%') ELSE true END AS ok
   FROM (SELECT *, substr(url, length(origin) + 1) AS path FROM s) s JOIN o USING (origin))"""


VISITS = "SELECT site, CAST(depth AS BIGINT) AS depth, rank, url, role FROM visits"


def crawl(final: str = VISITS, pages: str = SITE_PAGES, more: tuple[int, ...] = (), start: str = "", budget: int = 8, lost: bool = True) -> str:
    """Three unrolled levels over the link formula of the site pages; ``budget`` pages per site."""
    link = lambda pos, dst, cond: f"SELECT page_id, origin, {pos} AS pos, {dst} AS dst FROM s WHERE {cond}"
    added = "".join(f" UNION ALL {link(6 + i, f'page_id + {n}', 'page_id % 6 < 4')}" for i, n in enumerate(more))
    base = f"""WITH s AS ({pages}),
    raw_links AS ({link(1, 'page_id * 2 + 3', 'page_id % 2 = 0')} UNION ALL {link(2, 'page_id * 2 + 6', 'page_id % 2 = 0')}
      UNION ALL {link(3, 'page_id + 3', 'page_id % 6 < 4')} UNION ALL {link(4, 'page_id + 15', 'true')} UNION ALL {link(5, 'page_id + 30', 'true')}{added}),
    one AS (SELECT page_id, origin, dst, min(pos) AS pos FROM raw_links WHERE dst <> page_id GROUP BY ALL),
    link AS (SELECT origin AS site, origin || '/jobs/' || CAST(page_id AS VARCHAR) AS url, origin || '/jobs/' || CAST(dst AS VARCHAR) AS dst, pos FROM one),
    page AS (SELECT url, page_id % 4 = 1 AS structured FROM s),
    o AS (SELECT origin, min(page_id) AS p FROM s{start} GROUP BY origin),
    f0 AS (SELECT origin AS site, origin || '/jobs/none' AS url, 0 AS pr, 0 AS pos FROM o WHERE {lost} UNION ALL
      SELECT origin, origin || '/jobs/' || CAST(p AS VARCHAR), 0, 1 FROM o)"""
    none = "SELECT CAST(NULL AS VARCHAR) AS site, CAST(NULL AS VARCHAR) AS url, 0 AS depth, 0 AS rank, false AS got WHERE false"
    seen = none
    outs = []
    for d in range(3):
        nxt = f"""
    , q{d} AS (SELECT site, url, min_by(pr, (pr, pos)) AS pr, min_by(pos, (pr, pos)) AS pos FROM f{d}
        WHERE (site, url) NOT IN (SELECT (site, url) FROM ({seen}) x) GROUP BY site, url),
    r{d} AS (SELECT q.site, q.url, page.url IS NOT NULL AS got, structured, row_number() OVER w AS rank,
        coalesce(sum(CASE WHEN page.url IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY q.site ORDER BY pr, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM q{d} q LEFT JOIN page ON page.url = q.url WINDOW w AS (PARTITION BY q.site ORDER BY pr, pos)),
    used{d} AS (SELECT site, sum(CASE WHEN got THEN 1 ELSE 0 END) AS n FROM ({seen}) x GROUP BY site),
    l{d} AS (SELECT r.site, r.url, {d} AS depth, rank, got, structured FROM r{d} r LEFT JOIN used{d} u ON u.site = r.site WHERE before + coalesce(n, 0) < {budget})"""
        base += nxt
        seen = f"{seen} UNION ALL SELECT site, url, depth, rank, got FROM l{d}"
        base += f"""
    , v{d} AS ({seen}),
    n{d} AS (SELECT l.site, l.rank, link.pos, link.dst FROM l{d} l JOIN link ON link.url = l.url LEFT JOIN v{d} v ON v.site = l.site AND v.url = link.dst
        WHERE l.got AND NOT l.structured AND (v.url IS NULL OR v.depth > l.depth OR (v.depth = l.depth AND v.rank > l.rank))),
    c{d} AS (SELECT site, rank, count(*) AS n FROM n{d} GROUP BY site, rank),
    x{d} AS (SELECT l.*, CASE WHEN structured THEN 'postings' WHEN coalesce(n, 0) >= 3 OR ({d} = 0 AND coalesce(n, 0) > 0)
        THEN {"'listing'" if d < 2 else "'deep_listing'"} ELSE 'page' END AS role FROM l{d} l LEFT JOIN c{d} c ON c.site = l.site AND c.rank = l.rank WHERE got),
    f{d + 1} AS (SELECT n.site, n.dst AS url, n.rank AS pr, n.pos FROM n{d} n JOIN x{d} x ON x.site = n.site AND x.rank = n.rank WHERE x.role = 'listing')"""
        outs.append(f"SELECT site, depth, rank, url, role FROM x{d}")
    return f"{base}\n, visits AS ({' UNION ALL '.join(outs)}) {final}"


def html_postings(source: str) -> str:
    """Title, company and main text of pages that have enough of both."""
    return f"""SELECT *, CASE WHEN contains(full_title, ' : ') THEN trim(split_part(full_title, ' : ', 1))
        WHEN regexp_matches(full_title, '\\s+at\\s+') THEN trim(regexp_extract(full_title, '^(.*?)\\s+at\\s', 1)) ELSE full_title END AS title,
      CASE WHEN contains(full_title, ' : ') THEN trim(substr(full_title, strpos(full_title, ' : ') + 3))
        WHEN regexp_matches(full_title, '\\s+at\\s+') THEN trim(regexp_extract(full_title, '^.*?\\s+at\\s+(.*)$', 1)) ELSE '' END AS company
      FROM (SELECT *, trim(CASE WHEN {H1} <> '' AND contains({TITLE_TAG}, {H1}) THEN {TITLE_TAG} WHEN {H1} <> '' THEN {H1} ELSE {TITLE_TAG} END) AS full_title,
        {page_text('body', True)} AS description FROM (SELECT *, {ARTICLE} AS body FROM {source})) WHERE length(description) >= 100 AND full_title <> ''"""


def site_list(final: str) -> str:
    """Every posting of the list of sites with its place, as ``placed``."""
    page_no = "v.depth * 1000000000 + v.rank"
    site_pos = f"{FIRST_SITE} + CAST(regexp_extract(v.site, 'site([0-9]+)', 1) AS BIGINT)"
    source = "replace(v.site, 'https://', '')"

    def board(kind: str, name: str, of: int, title: str, url: str) -> str:
        token = f"'{name}' || CAST((posting_id // 10) % {of} AS VARCHAR)"
        return f"""SELECT '{kind}:' || {token} AS source, {token} AS board, '{title} ' || CAST(posting_id AS VARCHAR) AS title, {url.format(token)} || CAST(posting_id AS VARCHAR) AS url,
          posting_id // 10 AS request_no, CAST(row_number() OVER (PARTITION BY posting_id // 10 ORDER BY posting_id) - 1 AS INT) AS item_pos, {DESC} AS description FROM p"""

    def linked(kind: str, name: str, of: int, board_no: int) -> str:
        return f"""SELECT {site_pos}, {page_no}, {board_no}, '{kind}:{name}' || CAST(s.page_id % {of} AS VARCHAR) FROM visits v JOIN s ON s.url = v.url WHERE v.depth = 0 AND v.role <> 'postings'"""

    rest = f"""
    , p AS ({POSTINGS}),
    hosted AS ({board('greenhouse', 'co', 7, 'Green', "'https://boards.greenhouse.io/' || {} || '/jobs/'")} UNION ALL {board('lever', 'lv', 3, 'Lever', "'https://jobs.lever.co/' || {} || '/'")}),
    boards(site_pos, page_no, board_no, source) AS (SELECT 1, 0, 0, 'greenhouse:co3' UNION ALL {linked('greenhouse', 'co', 7, 0)} UNION ALL {linked('lever', 'lv', 3, 1)}),
    failed AS (SELECT site_pos, min(page_no) AS failed_page, min(board_no) AS failed_board, min(request_no) AS failed_request FROM boards JOIN hosted USING (source)
      WHERE board = '{BROKEN_BOARD}' AND request_no >= {BROKEN_FROM} GROUP BY site_pos),
    met AS (
      SELECT site_pos, page_no, board_no, request_no, item_pos, title, url, source, description FROM boards JOIN hosted USING (source) WHERE NOT (board = '{BROKEN_BOARD}' AND request_no >= {BROKEN_FROM})
      UNION ALL SELECT 3, 0, 0, page_id + 1000000000, 0, 'Guest security role ' || CAST(page_id AS VARCHAR), 'https://www.linkedin.com/jobs/view/70000' || CAST(page_id AS VARCHAR) || '/', 'linkedin', '' FROM s WHERE page_id % 10 = 0
      UNION ALL SELECT {site_pos}, {page_no}, -1, 0, 2, 'Job ' || CAST(s.page_id AS VARCHAR), v.url, {source}, '' FROM visits v JOIN s ON s.url = v.url WHERE role = 'postings'
      UNION ALL SELECT {site_pos}, {page_no}, -1, 0, 0, title, h.url, {source}, description FROM visits v JOIN ({html_postings('s')}) h ON h.url = v.url WHERE role = 'page'),
    placed AS (SELECT met.* FROM met LEFT JOIN failed USING (site_pos) WHERE failed_page IS NULL OR (page_no, board_no, request_no) < (failed_page, failed_board, failed_request))"""
    pages = dict(pages=BOARD_SITE_PAGES, more=MORE_LINKS, start=" WHERE page_id % 4 <> 1", budget=25, lost=False)
    return crawl(f"{rest} {final}", **pages)


def site_found() -> str:
    """What a search for "security" keeps of them: each URL at its first place, with what is mined from its text."""
    texts = f"""SELECT row_number() OVER (ORDER BY site_pos, page_no, board_no, request_no, item_pos) AS posting_id, '' AS location, []::VARCHAR[] AS tags, *
      FROM (SELECT *, row_number() OVER (PARTITION BY lower(rtrim(url, '/')) ORDER BY site_pos, page_no, board_no, request_no, item_pos) AS copy FROM placed) WHERE copy = 1"""
    return f", u AS (SELECT * FROM ({texts}) WHERE {any_term(SEARCH_TEXT, ['security'])}), {summary('u')}, {requirements('u')}"


def where(condition: str) -> str:
    return f"{WITH} SELECT posting_id, title FROM (SELECT *, {POSTED_ON} AS posted_on FROM p) WHERE {condition}"


def oracle_sql() -> dict[str, str]:
    terms = CYBER + SOFTWARE + DATA + DEVOPS + SUPPORT + TERMS
    crawled = f"""SELECT 'Job ' || CAST(s.page_id AS VARCHAR) AS title, '' AS company, v.url, v.site AS source, '' AS description
            FROM visits v JOIN s ON s.url = v.url WHERE role = 'postings'
          UNION ALL SELECT title, company, h.url, v.site, description FROM visits v JOIN ({html_postings('s')}) h ON h.url = v.url WHERE role = 'page'"""
    many = dict(pages=MANY_SITE_PAGES, more=MORE_LINKS, start=" WHERE page_id % 4 <> 1", budget=25)
    matched = labels("txt", [(t, term(t)) for t in dict.fromkeys(terms)], True)
    sheet_title = "CASE seq % 4 WHEN 0 THEN '''  =1+' || title WHEN 1 THEN '''-' || title ELSE title END"
    sheet_text = "regexp_replace(description, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    routes = """CASE page_id % 10 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} WHEN 5 THEN {5}
      WHEN 6 THEN {6} WHEN 7 THEN {7} WHEN 9 THEN {8} END"""
    pid = "CAST(page_id AS VARCHAR)"
    page_host = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
    site6 = f"'site' || {pid} || '.example.com'"
    root6 = f"'https://Site' || {pid} || '.Example.com'"
    route_cols = {
        "provider": routes.format("'workday'", "'greenhouse'", "'lever'", "'remotive'", "'site'", "'site'", "'site'", "'linkedin'", "'site'"),
        "board": routes.format(f"'tenant' || {pid} || '.wd3.myworkdayjobs.com/Site'", f"'co' || {pid}", f"'co' || {pid}", *["''"] * 6),
        "source": routes.format(f"'workday:tenant' || {pid} || '/Site'", f"'greenhouse:co' || {pid}", f"'lever:co' || {pid}", "'remotive'",
                                "'ninjajobs'", page_host, site6, "'linkedin'", "'notgreenhouse.io'"),
        "start_urls": routes.format("''", "''", "''", "''", "'https://ninjajobs.org/jobs https://ninjajobs.org/'",
                                    "url", f"{root6} || '/ ' || {root6} || '/careers ' || {root6} || '/jobs'", "''", "'https://notgreenhouse.io/acme'"),
    }
    bad = "(posting_id % 10 = 7 AND posting_id > 60)"
    out = {
        "keyword_any": where(any_term(SEARCH_TEXT, ["data engineer", "help-desk", "VPN"])),
        "keyword_all": where(f"{any_term(SEARCH_TEXT, ['full time'])} AND {any_term(SEARCH_TEXT, ['security'])}"),
        "keyword_none": where(f"NOT {any_term(SEARCH_TEXT, ['senior', 'remote'])}"),
        "title_only": where(any_term("title", ["cyber security", "SOC"])),
        "field_search": where(any_term(SEARCH_TEXT, CYBER + SUPPORT)),
        "term_table": f"""{WITH}, d AS (SELECT posting_id, {SEARCH_TEXT} AS txt FROM p)
          SELECT posting_id, unnest({matched}) AS term FROM d""",
        "remote_class": f"{WITH} SELECT posting_id, remote FROM ({remote()})",
        "remote_filter": f"{WITH} SELECT posting_id, remote FROM ({remote()}) WHERE remote IN ('Remote', 'Hybrid')",
        "posted_parse": f"""{WITH} SELECT posting_id, CAST(posted_on AS VARCHAR) AS posted_on, {POSTED_DATE} AS posted_date
          FROM (SELECT *, {POSTED_ON} AS posted_on FROM p)""",
        "posted_within": where(f"posted_on >= {TODAY} - 5"),
        "posted_within_or_undated": where(f"posted_on IS NULL OR posted_on >= {TODAY} - 5"),
        "location_any": where("contains(lower(location), 'austin') OR contains(lower(location), 'berlin')"),
        "domain_allow": where(on_domain("example.com")),
        "domain_deny": where(f"NOT {on_domain('example.com')} AND NOT {on_domain('other.test')}"),
        "domain_table": f"""{WITH}, d AS (SELECT CASE r_regionkey WHEN 0 THEN 'example.com' WHEN 1 THEN 'other.test' ELSE lower(r_name) || '.test' END AS domain FROM region)
          SELECT posting_id, url FROM (SELECT *, {HOST} AS h FROM p) WHERE EXISTS (SELECT 1 FROM d WHERE h = domain OR h LIKE '%.' || domain)""",
        "full_filter": f"{WITH} SELECT seq, title, remote, {POSTED_DATE} AS posted_date FROM ({found('p')})",
        "education": f"{WITH} SELECT posting_id, education FROM ({education()})",
        "certifications": f"{WITH} SELECT posting_id, {CERT_TEXT} AS certifications FROM p",
        "clearance": f"{WITH} SELECT posting_id, clearance FROM ({clearance()})",
        "experience": f"{WITH} SELECT posting_id, experience FROM ({experience()})",
        "requirements": f"{WITH}, {requirements()} SELECT posting_id, requirements FROM reqs",
        "summary": f"{WITH}, {summary()} SELECT posting_id, summary FROM sums",
        "enrich": f"""{WITH}, {requirements()} SELECT seq, title, remote, {POSTED_DATE} AS posted_date, education, experience, {CERT_TEXT} AS certifications,
          clearance, requirements FROM (SELECT *, {POSTED_ON} AS posted_on FROM ({remote(f"({education(f'({clearance(chr(40) + experience() + chr(41))})')})")})) JOIN reqs USING (posting_id)""",
        "distinct_first": """SELECT host, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM
          (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)) WHERE n = 1""",
        "dedupe_postings": f"WITH RECURSIVE p AS ({POSTINGS}), {DEDUPE} SELECT posting_id, title, company, source, url FROM uniq",
        "first_matches": where(any_term(SEARCH_TEXT, ["security"])) + " ORDER BY seq LIMIT 50",
        "search_end_to_end": search(),
        "stream_ingest": f"""WITH RECURSIVE base AS ({POSTINGS}), {streamed(DEDUPE)}, f AS (SELECT * FROM ({education(f"({clearance(f'({experience(chr(40) + found(chr(117) + chr(110) + chr(105) + chr(113)) + chr(41))})')})")})), {summary('f')}, {requirements('f')}
          SELECT title, company, location, remote, url, source, {POSTED_DATE} AS posted_date, summary, education, experience, array_to_string(tags, '|') AS tags, {CERT_TEXT} AS certifications, clearance, requirements
          FROM f JOIN sums USING (posting_id) JOIN reqs USING (posting_id)""",
        "stream_quarantine": f"""WITH base AS ({POSTINGS}), {streamed("q AS (SELECT DISTINCT board, request_no, run FROM raw, torn WHERE board = 's1' AND request_no >= torn_at)")}
          SELECT board, request_no, CASE WHEN run = 1 AND request_no % 2 = 1 THEN 'unreadable' ELSE 'after' END AS fault FROM q""",
        "quarantine_faults": f"""{WITH}, k AS (SELECT [{', '.join(map(q, FAULTY))}][posting_id % {len(FAULTY)} + 1] AS provider, {BOARD} AS board, CAST(posting_id AS INT) AS request_no, posting_id // {len(FAULTY)} AS nth FROM p),
          own AS (SELECT *, CASE WHEN nth % 9 = 4 THEN CASE WHEN provider IN ('lever', 'remoteok') THEN 'kind' ELSE 'shape' END
            WHEN nth % 50 = 39 THEN 'kind' WHEN nth % 70 = 69 THEN 'unreadable' END AS fault FROM k),
          ended AS (SELECT provider, board, min(request_no) AS ended_at FROM own WHERE fault IN ('kind', 'unreadable') GROUP BY ALL)
          SELECT provider, board, request_no, CASE WHEN fault IS NOT NULL THEN fault WHEN request_no > ended_at THEN 'after' ELSE '' END AS fault FROM own LEFT JOIN ended USING (provider, board)""",
        "normalize_remoteok": f"""{WITH} {shown(source="'remoteok'", url="CASE WHEN posting_id % 3 <> 0 AND url <> '' THEN url ELSE 'https://remoteok.com/remote-jobs/' || CAST(posting_id AS VARCHAR) END",
          posted_date="'2026-10-01'", salary=REMOTEOK_PAY)} FROM p WHERE posting_id % 17 <> 0""",
        "normalize_remotive": f"""{WITH} {shown(source="'remotive'", posted_date="'2026-09-30'", salary="'90k'",
          employment_type="CASE WHEN posting_id % 2 = 0 THEN 'Full Time' ELSE 'Part-Time Contract' END",
          tags="CASE WHEN posting_id % 4 <> 0 THEN 'Security|' ELSE '' END || array_to_string(tags, '|')")} FROM p""",
        "normalize_arbeitnow": f"""{WITH} {shown(source="'arbeitnow'", remote="CASE WHEN posting_id % 2 = 0 THEN 'Remote' ELSE 'Unknown' END",
          posted_date="strftime(make_timestamp((1790000000 + posting_id * 3600) * 1000000), '%Y-%m-%d')", employment_type="'full time, permanent'")}
          FROM p""",
        "normalize_greenhouse": f"""{WITH} {shown(source="'greenhouse:' || " + BOARD, remote="'Unknown'", tags="'Security'",
          company=f"CASE WHEN posting_id % 2 = 0 AND company <> '' THEN company ELSE {BOARD} END",
          posted_date="CASE WHEN posting_id % 3 = 0 THEN '2026-09-29' ELSE '2026-09-30' END")} FROM p""",
        "normalize_lever": f"""{WITH} {shown(source="'lever:' || " + BOARD, company=BOARD,
          remote="CASE posting_id % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'On-site' ELSE 'Unknown' END", employment_type="'Full-time'",
          posted_date="strftime(make_timestamp((1790000000000 + posting_id * 86400000) * 1000), '%Y-%m-%d')",
          salary="'USD 90,000' || CASE posting_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-90,500' ELSE '-91,000' END || ' per year'",
          tags="CASE WHEN posting_id % 2 = 0 THEN 'Blue|Ops' ELSE 'Blue' END",
          description=DESC + " || chr(10) || 'Tools & more' || chr(10) || 'OSCP' || chr(10) || 'Go' || chr(10) || 'End'")} FROM p""",
        "normalize_workday": f"""{WITH}, l AS (SELECT *, posting_id // 2 AS j FROM p WHERE posting_id % 19 <> 0),
          f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id // 500, j ORDER BY posting_id) AS n FROM l) WHERE n = 1),
          d AS (SELECT posting_id // 2 AS dj, title || ' (detail)' AS dtitle, company AS dcompany, {DESC} AS ddesc,
            CASE WHEN posting_id % 4 = 0 THEN '2026-10-01' END AS dstart FROM p WHERE posting_id % 2 = 0 AND posting_id % 6 <> 0)
          SELECT coalesce(dtitle, title) AS title, coalesce(nullif(dcompany, ''), {WORKDAY_BOARD}) AS company,
            CASE WHEN dj IS NOT NULL THEN 'Remote - USA; Austin, TX' ELSE location END AS location,
            CASE WHEN dj IS NOT NULL THEN 'Remote' ELSE 'On-site' END AS remote,
            'https://' || {WORKDAY_BOARD} || '.wd5.myworkdayjobs.com/External/job/J' || CAST(j AS VARCHAR) AS url,
            'workday:' || {WORKDAY_BOARD} || '/External' AS source, coalesce(dstart, posted_raw) AS posted_date,
            CASE WHEN dj IS NOT NULL THEN 'Full time' ELSE '' END AS employment_type, '' AS salary, 'R' || CAST(posting_id AS VARCHAR) AS tags,
            coalesce(ddesc, '') AS description FROM f LEFT JOIN d ON dj = j""",
        "select_sources": f"""SELECT posting_id, provider, board, CAST(CASE provider WHEN 'remotive' THEN 0 WHEN 'remoteok' THEN 1 ELSE 2 END AS BIGINT) AS source_rank
          FROM (SELECT doc_id AS posting_id, CASE doc_id % 6 WHEN 0 THEN 'remoteok' WHEN 1 THEN 'remotive' WHEN 5 THEN 'greenhouse' END AS provider,
            'board' || CAST((doc_id // 10) % 4 AS VARCHAR) AS board FROM documents)
          WHERE provider IN ('remoteok', 'remotive') OR (provider = 'greenhouse' AND board = 'board1')""",
        "union_sources": f"""{WITH} SELECT CAST(CASE source WHEN 's2' THEN 0 WHEN 's0' THEN 1 ELSE 2 END AS BIGINT) AS source_rank, seq AS request_no, source, title FROM p""",
        "quarantine": f"""{WITH}, k AS (SELECT *, {BOARD} AS board FROM p), b AS (SELECT source, board, min(posting_id) AS failed FROM k WHERE {bad} GROUP BY ALL)
          SELECT CAST(posting_id AS INT) AS request_no, CASE WHEN posting_id >= failed THEN 'lost' ELSE 'usable' END AS state FROM k LEFT JOIN b USING (source, board)""",
        "jsonld_postings": f"""{WITH} SELECT '[New] ' || title || ' & Co' AS title, company,
          'Reston, VA, US' || CASE WHEN location <> '' THEN '; ' || location ELSE '' END AS location,
          CASE WHEN posting_id % 3 = 0 THEN 'Remote' ELSE 'Unknown' END AS remote,
          CASE WHEN posting_id % 5 = 0 THEN 'https://www.Careers.test/apply/1#x' ELSE 'https://www.Careers.test/p/' || CAST(posting_id AS VARCHAR) || '#f' END AS url,
          'www.careers.test' AS source, '2026-09-01' AS posted_date, 'FULL_TIME; CONTRACTOR' AS employment_type, 'USD 80,000-95,000 per year' AS salary,
          'IT' AS tags, 'CISSP|Go' AS requirements, CASE WHEN posting_id % 3 = 0 THEN 'Bachelor''s' ELSE 'none' END AS education,
          CASE posting_id % 4 WHEN 0 THEN '3+ years' ELSE '5 years' END AS experience, {DESC} AS description FROM p WHERE posting_id % 2 = 0""",
        "html_text": f"SELECT page_id, {page_text('html')} AS text FROM pages",
        "page_links": f"WITH {LINKS} SELECT page_id, pos, link FROM ranked WHERE pos < 50",
        "html_page_postings": f"""SELECT page_id, title, company, regexp_replace(url, '#.*$', '') AS url, {page_host} AS source, '' AS posted_date, description
          FROM ({html_postings('pages')})""",
        "page_titles": f"""SELECT page_id, 'Engineer ' || {pid} AS title,
          CASE page_id % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Beta Corp' ELSE '' END AS company FROM pages""",
        "board_links": f"""SELECT page_id, source, provider, board, board_url FROM (
          SELECT page_id, 'greenhouse:acme' || {pid} AS source, 'greenhouse' AS provider, 'acme' || {pid} AS board, 'https://boards.greenhouse.io/acme' || {pid} AS board_url FROM pages
          UNION ALL SELECT page_id, 'workday:acme/Careers' || CAST(page_id % 3 AS VARCHAR), 'workday', 'acme.wd1.myworkdayjobs.com/Careers' || CAST(page_id % 3 AS VARCHAR),
            'https://Acme.wd1.myworkdayjobs.com/en-US/Careers' || CAST(page_id % 3 AS VARCHAR) FROM pages
          UNION ALL SELECT page_id, 'lever:beta', 'lever', 'beta', regexp_extract(url, '^([a-z]+:)', 1) || '//jobs.lever.co/beta/9?x=1' FROM pages)""",
        "route_urls": "SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in route_cols.items()) + " FROM pages",
        "robots_filter": f"WITH {ROBOTS} SELECT page_id, url FROM verdict WHERE ok",
        "site_places": site_list("SELECT * FROM placed"),
        "site_search": site_list(f"""{site_found()} SELECT site_pos, page_no, board_no, request_no, item_pos, title, url, source, remote, summary, requirements
          FROM ({remote('u')}) JOIN sums USING (posting_id) JOIN reqs USING (posting_id)"""),
        "site_search_first": site_list(f"""{site_found()} SELECT title, url, source, summary FROM u JOIN sums USING (posting_id)
          ORDER BY site_pos, page_no, board_no, request_no, item_pos LIMIT 200"""),
        **{name: f"""{WITH}, s AS (SELECT *, posting_id AS seq_, CASE WHEN seq % 4 = 0 THEN {mark} || '=1+' || title ELSE title END AS cell FROM p)
          SELECT cell AS title, company, url, array_to_string(tags, '; ') AS tags, '' AS requirements, {text} AS description, (SELECT count(*) FROM p) AS written FROM s"""
           for name, mark, text in (("sink_csv", "''''", sheet_text), ("sink_tsv_append", "''''", sheet_text), ("sink_json", "''", "description"), ("sink_json_append", "''", "description"))},
        "sink_formats": "SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'tsv' WHEN 2 THEN 'tsv' WHEN 3 THEN 'json' WHEN 4 THEN 'json' ELSE 'csv' END AS format FROM documents",
        "capped_cells": f"{WITH} SELECT seq, substr(repeat(description, 4), 1, 32767) AS description FROM p",
        "seed_lines": f"""SELECT 'site' || {pid} || '.example.com/openings' AS value, 'site' || {pid} || '.example.com' AS source, 'https://site' || {pid} || '.example.com/openings' AS start_urls
          FROM pages WHERE page_id % 4 >= 2""",
        "html_content": "SELECT page_id, url FROM pages WHERE page_id % 4 <> 1",
        "page_dates": """SELECT *, CASE WHEN meta_posted <> '' THEN meta_posted ELSE time_posted END AS posted FROM (SELECT page_id,
          CASE WHEN page_id % 5 = 0 THEN '2027-02-02' WHEN page_id % 3 = 0 THEN '2027-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS meta_posted,
          CASE page_id % 4 WHEN 1 THEN '2027-03-03' WHEN 2 THEN '5 March' ELSE '' END AS time_posted FROM pages)""",
        "crawl_reachable": crawl(),
        "crawl_postings": crawl(crawled),
        "crawl_many_sites": crawl(**many),
        "crawl_many_sites_postings": crawl(crawled, **many),
        "linkedin_postings": f"""SELECT 'SOC & Analyst ' || {pid} AS title, 'Acme Inc' AS company, 'United States' AS location, 'Remote' AS remote,
          'https://www.linkedin.com/jobs/view/40' || lpad({pid}, 8, '0') || '/' AS url, 'linkedin' AS source, '2026-10-06' AS posted_date,
          CASE WHEN page_id % 3 <> 0 THEN 'Full-time' ELSE '' END AS employment_type, CASE WHEN page_id % 3 <> 0 THEN 'Entry level' ELSE '' END AS tags FROM pages""",
        "sheet_rows": f"""{WITH} SELECT {sheet_title} AS title, company, array_to_string(tags, '; ') AS tags, 'a | b' AS requirements, url,
          substr(CASE WHEN regexp_matches({sheet_text}, '^ *[=+\\-@\\t\\r]') THEN '''' || {sheet_text} ELSE {sheet_text} END, 1, 32767) AS description FROM p""",
    }
    return out
