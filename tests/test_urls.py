from urllib.parse import urldefrag, urljoin


from postlode.functions.urls import bare_host, host, host_suffixes, on_domain, resolve, route, url_key


def test_links_resolve_as_in_a_browser(apply):
    refs = ["/jobs/1", "b", "../c", "./d/", "?z=1", "#f", "", "//o.test/p", "mailto:x@y", "HTTPS://Q.test/a#b", "g/../../h",
            "../../../z", "/a/./b/../c", "..", "x?y=/../z", "a b"]
    rows = [(b, r) for b in ("https://a.test/x/y?q#f", "http://a.test", "https://a.test/x/y/") for r in refs]
    assert apply(lambda a, b, *_: resolve(a, b), rows) == [urldefrag(urljoin(b, r))[0] for b, r in rows]


def test_hosts(apply):
    rows = ["https://User:pw@WWW.Acme.test:8080/x", "//a_b.example.com/", "no host", "https://[::1]:80/", "http://x.test?y"]
    assert apply(lambda a, *_: host(a), rows) == ["www.acme.test", "a_b.example.com", "", "[::1]", "x.test"]
    assert apply(lambda a, *_: bare_host(a), rows[:1]) == ["acme.test"]
    assert apply(lambda a, *_: host_suffixes(a), ["https://a.b.test/"]) == [["a.b.test", "b.test", "test"]]
    assert apply(lambda a, *_: url_key(a), ["https://A.test/Jobs//", "", None]) == ["https://a.test/jobs", None, None]
    rows = ["https://jobs.acme.test/1", "https://acme.test", "https://badacme.test/"]
    assert apply(lambda a, *_: on_domain(a, "https://www.Acme.test./x"), rows) == [True, True, False]
    assert apply(lambda a, *_: on_domain(a, " "), rows) == [False] * 3


def test_routing(apply):
    rows = ["orbit.wd5.myworkdayjobs.com/en-US/Ext/job/X", "https://orbit.wd5.myworkdayjobs.com/job/X", "https://boards.greenhouse.io/orbit/jobs/1",
            "https://boards.greenhouse.io/embed/job_board?for=orb%20it", "https://boards.greenhouse.io/embed/job_board", "https://jobs.lever.co/orbit",
            "https://api.lever.co/v0", "www.linkedin.com", "NinjaJobs.org", "https://remotive.com/x", "orbit.test", "https://orbit.test/careers?x=1",
            "https://evil-lever.co/x", " ", "ftp://orbit.test"]
    got = [r and (r["provider"], r["board"], r["source"]) for r in apply(lambda a, *_: route(a), rows)]
    assert got == [
        ("workday", "orbit.wd5.myworkdayjobs.com/Ext", "workday:orbit/Ext"), None, ("greenhouse", "orbit", "greenhouse:orbit"),
        ("greenhouse", "orb it", "greenhouse:orb it"), ("site", "", "boards.greenhouse.io"), ("lever", "orbit", "lever:orbit"),
        ("site", "", "api.lever.co"), ("linkedin", "", "linkedin"), ("site", "", "ninjajobs"), ("remotive", "", "remotive"),
        ("site", "", "orbit.test"), ("site", "", "orbit.test"), ("site", "", "evil-lever.co"), None, None]
    starts = [r["start_urls"] for r in apply(lambda a, *_: route(a), ["orbit.test", "https://orbit.test/careers?x=1"])]
    assert starts == [["https://orbit.test/", "https://orbit.test/careers", "https://orbit.test/jobs"], ["https://orbit.test/careers?x=1"]]
