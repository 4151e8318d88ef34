"""Inputs derived from the given tables.

The tables hold no job postings, so postings are made from ``documents`` by decorating every row, text unchanged
and whole, with fields computed from ``doc_id``.  The SELECT below is one text that runs as it is in Spark and in
DuckDB; the checks prefix it to their SQL.
"""

AS_OF = "2026-10-08"

POSTINGS = """
SELECT doc_id AS posting_id, doc_id AS seq,
  CASE doc_id % 6 WHEN 0 THEN 'SOC Analyst' WHEN 1 THEN 'Senior Security Engineer' WHEN 2 THEN 'Data Engineer (Remote)'
    WHEN 3 THEN 'Back-End Developer' WHEN 4 THEN 'Help Desk Lead' ELSE 'Cyber-Security Manager' END
    || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' ' || cast(doc_id % 40 AS string) END AS title,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Company ' || cast(doc_id % 9 AS string) END AS company,
  CASE doc_id % 5 WHEN 0 THEN 'Remote - US' WHEN 1 THEN 'Hybrid - Austin, TX' WHEN 2 THEN 'On-site, Denver'
    WHEN 3 THEN 'Berlin' ELSE '' END AS location,
  CASE doc_id % 3 WHEN 0 THEN 's0' WHEN 1 THEN 's1' ELSE 's2' END AS source,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'https://' || CASE doc_id % 4 WHEN 0 THEN 'jobs.example.com' WHEN 1 THEN 'www.example.com'
    WHEN 2 THEN 'badexample.com' ELSE 'careers.other.test' END || '/Jobs/' || cast(doc_id % 700 AS string)
    || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END END AS url,
  CASE doc_id % 12 WHEN 0 THEN '2026-10-01T12:00:00Z' WHEN 1 THEN 'Posted 3 Days Ago' WHEN 2 THEN 'Posted Today'
    WHEN 3 THEN 'yesterday' WHEN 4 THEN '2 weeks ago' WHEN 5 THEN 'Oct 1, 2026' WHEN 6 THEN 'Posted on 1st October 2026'
    WHEN 7 THEN 'not a date' WHEN 8 THEN '10/5/2026' WHEN 9 THEN 'Published: 05 October 2026 (updated)'
    WHEN 10 THEN 'Posted 30+ Days Ago' ELSE '' END AS posted_raw,
  split(CASE WHEN doc_id % 2 = 0 THEN 'security,full-time' ELSE 'data' END, ',') AS tags,
  text || chr(10) || CASE doc_id % 7
    WHEN 0 THEN 'This is a fully remote role.' WHEN 1 THEN 'This position is not remote.' WHEN 2 THEN 'Secure remote access VPN needed.'
    ELSE 'Full-time role in our team here.' END || chr(10)
    || CASE doc_id % 10 WHEN 9 THEN 'Our people say this place is good.' WHEN 8 THEN 'What you''ll need:'
       WHEN 7 THEN 'Minimum Qualifications' ELSE 'Requirements' END || chr(10)
    || CASE doc_id % 5
    WHEN 0 THEN '- Bachelor''s degree or equivalent experience' WHEN 1 THEN '- 03+ years of security experience'
    WHEN 2 THEN '- CISSP or CompTIA Security+' WHEN 3 THEN '- Active Secret clearance' ELSE '- PhD and 2-4 years of Python experience' END
    || chr(10) || CASE doc_id % 13
    WHEN 0 THEN '* Master''s degree in computing, B.S. accepted' WHEN 1 THEN '* AWS Certified, AZ-500 and GCP professional'
    WHEN 2 THEN '* TS/SCI with full-scope poly' WHEN 3 THEN '* Top Secret clearance' WHEN 4 THEN '* OSCP, CEH or GPEN; DoD 8570 applies'
    WHEN 5 THEN '* 5 years of relevant work experience and 10 yrs exp' WHEN 6 THEN '* A college degree is a plus'
    WHEN 7 THEN '* high school diploma' WHEN 8 THEN '* ISO 27001 lead auditor, Six Sigma, PMP' WHEN 9 THEN '* Security clearance is required'
    WHEN 10 THEN '* Grade A+ service, Network+ or Linux +' WHEN 11 THEN '* 4-year degree in lieu of degree rules'
    ELSE '* Must have Kubernetes (CKA, CKAD)' END
    || chr(10) || 'Benefits' || chr(10) || 'Paid leave' AS description
FROM documents
"""

# A landed crawl made from ``pages``: every page keeps its markup and gains links to other pages of its site; the
# first site holds a third of all pages.  Every fourth page carries a schema.org posting.
SITE_PAGES = """
SELECT page_id,
  'https://site' || cast(CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id % 5 + 1 END AS string) || '.example.com' AS origin,
  'https://site' || cast(CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id % 5 + 1 END AS string) || '.example.com/jobs/'
    || cast(page_id AS string) AS url,
  html
    || CASE WHEN page_id % 4 = 1 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["JobPosting"],"title":"Job '
       || cast(page_id AS string) || '"}]}</script>' ELSE '' END
    || CASE WHEN page_id % 2 = 0 THEN '<a href="/jobs/' || cast(page_id * 2 + 3 AS string) || '">a</a><a href="'
       || cast(page_id * 2 + 6 AS string) || '#top">b</a>' ELSE '' END
    || CASE WHEN page_id % 6 < 4 THEN '<a href="../jobs/' || cast(page_id + 3 AS string) || '">c</a><a href="https://other.test/jobs/1">x</a>'
       ELSE '' END
    || '<a href="/jobs/' || cast(page_id + 15 AS string) || '">d</a><a href="/jobs/' || cast(page_id + 30 AS string) || '">e</a>'
    AS html
FROM pages
"""

# The same pages as many sites: the first still holds a third of all pages, every hundred page numbers make another.
# Pages have more links, so that a crawl meets the page budget of a site.
_FEW, _MANY = "page_id % 5 + 1", "cast(floor(page_id / 100) AS bigint) + 1"
MORE_LINKS = (9, 12, 18, 21, 24, 27)
MANY_SITE_PAGES = SITE_PAGES.replace(_FEW, _MANY).replace(
    "\n    AS html",
    "\n    || CASE WHEN page_id % 6 < 4 THEN " + " || ".join(f"""'<a href="/jobs/' || cast(page_id + {n} AS string) || '">f</a>'""" for n in MORE_LINKS) + " ELSE '' END\n    AS html",
)

# The same sites, every page with two hosted boards: the start pages of crawls lead to them.
BOARD_SITE_PAGES = MANY_SITE_PAGES.replace(
    "\n    AS html",
    """
    || '<a href="https://boards.greenhouse.io/co' || cast(page_id % 7 AS string) || '">g</a><iframe src="https://jobs.lever.co/lv'
    || cast(page_id % 3 AS string) || '"></iframe>'
    AS html""",
)
# The list of sites searched: blank, a board by two addresses, a board of pages, a source without payloads, then every site.
FIXED_SITES = ((0, "  "), (1, "https://boards.greenhouse.io/co3"), (3, "de.linkedin.com"), (4, "boards.greenhouse.io/embed/job_board?for=co3"), (5, "remotive.com"))
FIRST_SITE = 10
BROKEN_BOARD, BROKEN_FROM = "lv2", 8
# Providers whose payloads go wrong.
FAULTY = ("remotive", "lever", "greenhouse", "remoteok", "arbeitnow")
