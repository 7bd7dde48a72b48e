"""URL filters: rules against a plain matcher, aliases on hand-made pages."""

import re

import pytest

from chatlake.llm import urlfilter

RULES = urlfilter.RULES


def plain(url):
    m = re.match(r"(?s)^.*?://(.*)$", url or "")
    if not m:
        return "", "", None, "allow"
    host = re.match(r"[^/?#]*", m[1])[0]
    path = re.match(r"[^?#]*", m[1][len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h), len(p), v == "allow", h + p, v) for v, h, p in RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")


@pytest.fixture()
def judge(spark):
    def run(pages, **more):
        df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages],
                                   "page_id long, url string, html string, verdict string")
        return {r["page_id"]: r for r in urlfilter.judge_urls(df, urlfilter.rules_frame(spark), **more).collect()}
    return run


def test_rules(judge):
    urls = [None, "", "no url", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z",
            "http://example.com/en/1", "http://b.example.com/en/", "http://badexample.com/en/1", "http://x.net/es/1",
            "http://x.net/es", "http://x.net/fr/q?a=/es/", "http://x.net?/es/", "http://net/es/", "http://x.org/en/",
            "a://b://c.com/", "http://www.example.com/de/", "http://m.www.example.com/en/", "://x.net/fr/", "http:///en/"]
    rows = judge([(i, u, None) for i, u in enumerate(urls)])
    for i, u in enumerate(urls):
        assert tuple(rows[i][c] for c in ("host", "path", "rule", "verdict")) == plain(u), u
    assert judge([]) == {}


def test_aliases(judge, spark):
    canonical = '<html><head><LINK href="{}" data-x="1" Rel=\'canonical\'></head>'
    refresh = '<meta http-equiv="refresh" content="5; URL=\'{}\'">'
    pages = [
        (1, "http://x.net/es/bad", None),                                     # blocked by a rule
        (2, "http://y.org/a", canonical.format("http://x.net/es/bad#top")),   # alias of 1
        (3, "http://y.org/b#frag", refresh.format("/a")),                     # alias of an alias, relative
        (4, "http://z.com/c", refresh.format("http://y.org/a")),              # explicit allow stands
        (5, "http://q.org/d", canonical.format("http://z.com/other")),        # allow passes nothing on
        (6, "http://q.org/e/f", canonical.format("../x")),                    # an unknown page
        (7, "http://y.org/b", None),                                          # 3 without its fragment
        (8, "http://r.org/g", canonical.format("http://gone.net/fr/x")),      # target has no page
        (9, "http://r.org/h", '<link rel="stylesheet" href="http://x.net/es/bad">'),
        (10, "http://q.org/hop", None), (11, "http://q.org/d", None),
        (12, None, canonical.format("http://x.net/es/bad"))]
    more = spark.createDataFrame([("http://q.org/hop", "http://y.org/b"), (None, "http://x.net/es/bad")],
                                 "source string, target string")
    rows = judge(pages, redirects=more)
    assert {i for i, r in rows.items() if r["verdict"] == "block"} == {1, 2, 3, 7, 8, 10}
    assert rows[4]["rule"] == "com/" and rows[2]["rule"] is None
    assert rows[4]["component"] == rows[1]["component"]


def test_many_rules_take_the_join(judge, monkeypatch):
    monkeypatch.setattr(urlfilter, "RULES_SENT", 1)
    assert judge([(1, "http://x.net/es/1", None)])[1]["verdict"] == "block"


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    url = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    for r in urlfilter.judge_urls(pages, urlfilter.rules_frame(spark)).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(url[r["page_id"]])


def test_links_with_entities_and_dot_segments(spark):
    links = [("https://h/a/b/c", "../x", "https://h/a/x"), ("https://h/a/b/c", "./y/./z/..", "https://h/a/b/y/"),
             ("https://h/a", "../../x?p=../q", "https://h/x?p=../q"), ("https://h/a", "/x?a=1&amp;b=2", "https://h/x?a=1&b=2"),
             ("https://h/a", "/x?a=&amp;lt;&#38;&#x27;", "https://h/x?a=&lt;&'"), ("https://h/a", "/.x/..y", "https://h/.x/..y")]
    pages = spark.createDataFrame([(u, f'<link rel="canonical" href="{to}">') for u, to, _ in links],
                                  "url string, html string")
    assert sorted(map(tuple, urlfilter.page_links(pages).collect())) == sorted((u, t) for u, _, t in links)
    rows = [(1, "https://ok.org/a/b", '<link rel="canonical" href="../bad/x?a=1&amp;b=2">'),
            (2, "https://ok.org/bad/x?a=1&b=2", '<link rel="canonical" href="https://evil.org/">')]
    rules = urlfilter.rules_frame(spark, [("block", "evil.org", "/")])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["verdict"] for r in urlfilter.judge_urls(pages, rules).collect()] == ["block", "block"]
