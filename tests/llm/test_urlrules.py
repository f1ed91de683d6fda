from pyspark.sql import functions as F

from quillon.llm import urlrules as U

SCHEMA = "page_id long, url string, html string, host string, verdict string"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def own(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_aliases(spark):
    link = lambda to: f'<html><link href="{to}" rel="canonical">'
    rows = [
        (1, "http://a.org/x", link("http://b.org/es/1")),
        (2, "http://c.org/y#part", '<META HTTP-EQUIV=refresh content="0; url=http://a.org/x">'),
        (3, "http://d.org/z", link("/w")),
        (4, None, link("http://b.org/es/1")),
        (5, "junk", ""),
        (6, "http://q.net/a", link("http://k.net/de/1") + link("http://b.com/en/1")),
        (7, "HTTP://A.example.COM/en/77?x#y", None),
        (8, "http://A.example.COM/en/6", link("http://a.org/x")),
        (9, "://xn.org/es/a#b", None),
        (10, "http://host?q=/en/", None),
        (11, "http://ü.com/en/", None),
        (12, "http://mycom/en/", None),
        (None, "http://a.net/de/81", None),
        (1, "http://a.org/x", None),
        (13, "http://v.example.net/de/8/" + "p" * 50000, None),
    ]
    found = U.judge(spark.createDataFrame([(*r, "h", "v") for r in rows], SCHEMA)).collect()
    assert len(found) == len(rows)
    handed = {1: "block", 2: "block", 6: "allow"}
    plain = {(i, u): own(u) for i, u, _ in rows}
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found}
    assert got == {(i, h, p, rule, says or handed.get(i, "allow")) for (i, _), (h, p, rule, says) in plain.items()}


def test_no_rows(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spellings_of_one_address(spark):
    node = lambda u: spark.range(1).select(U._node(F.lit(u))).first()[0]
    same = ["http://A.org", "HTTP://a.ORG:80/", "http://a.org:/#top", " http://a.org/./b/.. "]
    assert {node(u) for u in same} == {"http://a.org/"}
    assert node("https://a.org:80/X?Y#z") == "https://a.org:80/X?Y" and node("http://a.org/b/./c/../d.e/..f?q=/../") == "http://a.org/b/d.e/..f?q=/../"
    to = lambda link: spark.range(1).select(U._node(U._resolved(F.lit(link), F.lit("http://h.org/a/b/c?q")))).first()[0]
    wanted = {"y.html": "/a/b/y.html", "../y": "/a/y", "../../../y": "/y", "./": "/a/b/", "..": "/a/", "?p=1": "/a/b/c?p=1", "#f": "/a/b/c?q", "/w": "/w", "y?z=://x": "/a/b/y?z=://x"}
    assert {k: to(k) for k in wanted} == {k: "http://h.org" + v for k, v in wanted.items()}
    assert to("//o.org/x") == "http://o.org/x" and to("mailto:x@y") is None and to("HTTPS://O.org:443") == "https://o.org/"


def test_relative_mixed_and_cyclic_links(spark):
    link = lambda to: f'<html><link href="{to}" rel="canonical">'
    rows = [
        (1, "http://r.org/dir/x.html", link("y.html")),
        (2, "HTTP://R.org:80/dir/y.html", link("http://b.org/es/1")),
        (3, "http://c1.org/", link("HTTP://C2.org")),
        (4, "http://c2.org/", link("http://C3.org/?a=1&amp;b=2")),
        (5, "http://c3.org/?a=1&b=2", link("http://c1.org") + link("http://z.org/es/9")),
        (6, "http://self.org/", link("/")),
    ]
    found = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_links_in_all_their_forms(spark):
    pages = {
        "http://p1.org/": '''<link rel="canonical" href="http://b.com/it's">''',
        "http://p2.org/": "<LINK REL='nofollow  Canonical' HREF = http://b.com/2>",
        "http://p3.org/": '<link data-href="http://wrong.com/" rel=canonical href="http://b.com/3">',
        "http://p4.org/": '<link title="a > b" rel="canonical" href="http://b.com/4">',
        "http://p5.org/": '<link rel="canonical" href="http://b.com/a b">',
        "http://p6.org/": '<!-- <link rel="canonical" href="http://wrong.com/"> --><script>var s = \'<link rel="canonical" href="http://wrong.com/">\';</script ><link rel=canonical href=/6>',
        "http://p7.org/x/": '<base target="_blank"><base href="//cdn.org/deep/"><link rel="canonical" href="7">',
        "http://p8.org/": '''<meta http-equiv="Refresh" content="5; URL='http://b.com/8?a=1&amp;b=2'">''',
        "http://p9.org/": '<meta content="0;http://b.com/9" http-equiv=refresh><meta name="refresh" content="0; url=http://wrong.com/">',
        "http://p10.org/": '<link rel="canonicals" href="http://wrong.com/"><linked rel=canonical href="http://wrong.com/"><link rel="canonical"><link href="http://wrong.com/">',
        "http://p11.org/": "<link rel=canonical href=http://b.com/o'clock>",
        "http://p12.org/": '<link rel=canonical href="http://b.com/12" href="http://wrong.com/">',
        "http://p13.org/": "<title><link rel=canonical href=http://wrong.com/></title><link rel=canonical href='" + "x" * 50_000 + "'>",
        "http://p14.org/": "<link " + "a='b' " * 20_000 + "rel=canonical href=/14>",
        "http://p15.org/": None,
    }
    found = U.links(spark.createDataFrame(list(pages.items()), "url string, html string")).collect()
    wanted = {
        "http://p1.org/": "http://b.com/it's", "http://p2.org/": "http://b.com/2", "http://p3.org/": "http://b.com/3", "http://p4.org/": "http://b.com/4", "http://p5.org/": "http://b.com/a%20b", "http://p6.org/": "http://p6.org/6",
        "http://p7.org/x/": "http://cdn.org/deep/7", "http://p8.org/": "http://b.com/8?a=1&b=2", "http://p9.org/": "http://b.com/9", "http://p11.org/": "http://b.com/o'clock", "http://p12.org/": "http://b.com/12",
        "http://p13.org/": "http://p13.org/" + "x" * 50_000, "http://p14.org/": "http://p14.org/14",
    }
    assert len(found) == len(wanted) and {r.a: r.b for r in found} == wanted
