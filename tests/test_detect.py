from datetime import date

from pyspark.sql import functions as F

from postlode import rules
from postlode.functions.dates import date_from_epoch, normalize_date
from postlode.functions.detect import (
    detect_certifications, detect_clearance, detect_education, detect_experience, detect_remote, map_workplace,
)
from postlode.functions.salary import salary_text


def test_work_arrangement(apply):
    rows = [
        ("Detection Lead (Remote)", "", ""), ("", "Anywhere in EU", ""), ("", "Hybrid, Oslo", ""), ("", "Oslo", "This is a fully remote job."),
        ("", "Oslo", "Secure remote access for staff"), ("", "On-site, Oslo", ""), ("", "Oslo", "This is not remote."),
        ("", "Hybrid", "not remote"), ("", "", ""), (None, None, None),
    ]
    got = apply(lambda a, b, c, d: detect_remote(a, b, c, F.array().cast("array<string>")), rows)
    assert got == ["Remote", "Remote", "Hybrid", "Remote", "Unknown", "On-site", "On-site", "Hybrid", "Unknown", "Unknown"]
    assert apply(lambda a, *_: map_workplace(a, "lever"), ["HYBRID", "on-site", "onsite", "x", None]) == [
        "Hybrid", "On-site", "On-site", "Unknown", "Unknown"]
    assert apply(lambda a, *_: map_workplace(a, "workday"), ["Hybrid Remote", "Fully Remote", "On site", "Office", ""]) == [
        "Hybrid", "Remote", "On-site", "On-site", "Unknown"]


def test_education(apply):
    rows = ["Bachelor's degree or equivalent experience", "BS and a Master's degree", "B.S. in CS, Master’s degree", "Ph.D in physics",
            "a college degree helps", "Scrum Master", "GED or High School Diploma", "high school diploma", "2-year degree, in lieu of degree", ""]
    assert apply(lambda a, *_: detect_education(a), rows) == [
        "Bachelor's (or equivalent experience)", "Master's", "Master's, Bachelor's", "Doctorate", "Degree (level unspecified)", "",
        "High school diploma/GED", "High school diploma/GED", "Associate's (or equivalent experience)", ""]


def test_certifications(apply):
    rows = ["CISSP, C|EH or OSCP. Security + (DoD 8570). AWS Certified. AZ-104", "security and networking", "A+ team", "C++ and A++",
            "certified scrum master, OSCE3, 8140.03", "cissp"]
    assert apply(lambda a, *_: detect_certifications(a), rows) == [
        ["CISSP", "CEH", "OSCP", "CompTIA Security+", "AWS Certification", "Azure Certification", "DoD 8570/8140"], [], ["CompTIA A+"], [],
        ["OSCE", "Certified ScrumMaster", "DoD 8570/8140"], []]


def test_experience_and_clearance(apply):
    rows = ["03+ years of security experience", "2 to 4 yrs relevant work experience; 5 years of Go experience; 5 years exp",
            "founded 10 years ago", "1 year experience, 2 years experience, 3 years experience, 4 years experience", "6 plus years' experience"]
    assert apply(lambda a, *_: detect_experience(a), rows) == [
        "3+ years", "2-4 years; 5 years", "", "1 years; 2 years; 3 years", "6+ years"]
    rows = ["TS / SCI with CI poly", "Active Secret clearance", "Top Secret clearance", "top-secret clearance, Secret security clearance",
            "ability to obtain a clearance", "keep secrets", "public trust"]
    assert apply(lambda a, *_: detect_clearance(a), rows) == [
        ["TS/SCI", "Polygraph"], ["Secret"], ["Top Secret"], ["Top Secret", "Secret"], ["Security clearance"], [], ["Public Trust"]]


def test_registered_rules_extend_the_catalogue(apply):
    rules.register_rules("certifications", [("CDMP", r"(?U)\bCDMP\b")])
    rules.register_rules("field:robotics", ["ROS", "motion planning"])
    try:
        assert apply(lambda a, *_: detect_certifications(a), ["CDMP and CISA"]) == [["CISA", "CDMP"]]
        assert rules.expand_fields(["Robotics", "robotics"]) == ["ROS", "motion planning"]
    finally:
        rules._EXTRA["certifications"].clear()
        rules._EXTRA_TERMS.clear()


def test_dates(apply):
    as_of = F.lit(date(2026, 10, 8))
    cases = {
        "2026-10-01T12:00:00Z": "2026-10-01", "x 2026-02-30": "x 2026-02-30", "Posted 3 Days Ago": "2026-10-05", "just posted": "2026-10-08",
        "Posted Yesterday": "2026-10-07", "30+ days ago": "2026-09-08", "5 hours ago": "2026-10-08", "1 mo ago": "2026-09-08", "2 wks ago": "2026-09-24",
        "sep 9, 2026": "2026-09-09", "Posted on 2nd May 2026": "2026-05-02", "by Acme, October 5, 2026!": "2026-10-05", "5 October, 2026": "5 October, 2026",
        "12/31/2025": "2025-12-31", "2025/1/9": "2025-01-09", "Sept. 9, 2026": "Sept. 9, 2026", "Oct. 9, 2026": "2026-10-09", "99999999999 days ago": "99999999999 days ago",
        "13/40/2026": "13/40/2026", "  soon ": "soon", "": "", "0000-01-01": "0000-01-01",
    }
    assert apply(lambda a, *_: normalize_date(a, as_of), list(cases)) == list(cases.values())
    assert apply(lambda a, *_: date_from_epoch(a), ["1790000000", "x", None, "-86401", "1e9"]) == ["2026-09-21", "", "", "1969-12-30", "2001-09-09"]
    assert apply(lambda a, *_: date_from_epoch(a, True), ["1790000000000"]) == ["2026-09-21"]


def test_salary(apply):
    rows = [("100000", "150000", "USD", ""), ("0", "0", "USD", "year"), ("70000", "70000.0", "EUR", "Year"), (None, "2.5", "", "hour"),
            ("competitive", None, "", ""), ("3.5", None, "", None), (None, None, None, None)]
    assert apply(lambda a, b, c, d: salary_text(a, b, c, d), rows) == [
        "USD 100,000-150,000", "", "EUR 70,000 per year", "2 per hour", "competitive", "4", ""]
