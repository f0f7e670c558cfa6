import random

import pytest

from folio.llm.registry import URL_RULES
from folio.llm.url_filter import INLINE_RULES, filter_urls

PAGES = "page_id long, url string, html string, host string, rule string"


def judge(spark, rows, rules=URL_RULES, redirects=None):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    return {r["page_id"]: r for r in filter_urls(pages, rules, redirects).collect()}


def test_cases(spark):
    got = judge(
        spark,
        [
            (1, "http://A.org/x#f", '<link rel="canonical" href="http://b.example.com/en/1">'),
            (2, "http://c.org/", '<META http-equiv="Refresh" content="0; url=/en/z">'),
            (3, None, None),
            (4, "nourl", "x"),
            (5, "https://www.example.com/en/q", '<link href="http://b.example.com/en/1" rel=canonical>'),
            (6, "http://a.org/x", ""),
            (7, "HTTP://Sub.Example.COM/en/?a#b", None),
            (8, "http://example.com", None),
            (9, "http://badexample.net/es/", None),
        ],
    )
    assert (got[1]["verdict"], got[1]["via"], got[6]["verdict"]) == ("block", "alias", "block")
    assert (got[2]["verdict"], got[3]["host"], got[3]["path"], got[4]["rule"]) == ("allow", "", "", None)
    assert (got[5]["verdict"], got[5]["rule"]) == ("allow", "www.example.com/en/")
    assert (got[7]["host"], got[7]["path"], got[7]["rule"], got[7]["verdict"]) == ("sub.example.com", "/en/", "example.com/en/", "block")
    assert (got[8]["path"], got[8]["rule"]) == ("", None)
    assert got[9]["rule"] == "net/es/"


def test_many_rules_join_as_a_table(spark):
    rules = [*URL_RULES, *(("block", f"host{i}.test/") for i in range(INLINE_RULES))]
    rows = [(i, u, None) for i, u in enumerate(["http://a.host7.test/x", "http://www.example.com/en/1", "http://q.com/", "http://q.org/", None, "http://a.host7.test/x"])]
    few = judge(spark, [r for r in rows if "host7" not in (r[1] or "")])
    many = judge(spark, rows, rules)
    assert all(many[k]["rule"] == v["rule"] and many[k]["verdict"] == v["verdict"] for k, v in few.items())
    assert many[0]["rule"] == many[5]["rule"] == "host7.test/"


def test_empty(spark):
    assert judge(spark, []) == {}


@pytest.mark.parametrize("seed", range(2))
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://h{i}.{rng.choice(['org', 'org', 'org', 'net'])}/{rng.choice(['es', 'en'])}/" for i in range(40)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(25)] + [(None, urls[0]), (urls[0], urls[0])]
    got = judge(spark, [(i, u, None) for i, u in enumerate(urls)], redirects=spark.createDataFrame(edges, "from_url string, to_url string"))
    root = {u: u for u in urls}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in edges:
        if a and b:
            root[find(a)] = find(b)
    bad = {find(u) for i, u in enumerate(urls) if got[i]["rule"] in ("net/es/", "net/fr/")}
    assert all(got[i]["verdict"] == ("block" if find(u) in bad and got[i]["rule"] is None or got[i]["rule"] else "allow") for i, u in enumerate(urls))


def test_link_forms(spark):
    from folio.llm.url_filter import page_links

    page = "http://a.org/x/y/page.html"
    forms = {
        '<link rel="canonical" href="http://b.org/?a=1&amp;b=2">': "http://b.org/?a=1&b=2",
        '<link rel=canonical href=../z>': "http://a.org/x/z",
        '<link rel="canonical" href="./../../../q/./r?s=..">': "http://a.org/q/r?s=..",
        '<link rel="canonical" href="../..">': "http://a.org/",
        '<base href="http://c.org/d/e"><link rel="canonical" href="f">': "http://c.org/d/f",
        '<base href="/g/"><link rel="canonical" href="f">': "http://a.org/g/f",
        '<meta http-equiv="refresh" content="0; url=/h">': "http://a.org/h",
        '<link rel="canonical" href="//d.org/i">': "http://d.org/i",
        '<link rel="canonical" href="?k">': "http://a.org/x/y/page.html?k",
        '<!-- <link rel="canonical" href="http://bad.org/"> -->': None,
        '<script>"<link rel=canonical href=http://bad.org/>"</script>': None,
        '<!-- canonical': None,
        '<link rel="canonical" href="">': None,
    }
    # Each form is a page of its own, told apart by its query.
    pages = spark.createDataFrame([(f"{page}#{i}", html) for i, html in enumerate(forms)], "url string, html string")
    got = {r["from_url"]: r["to_url"] for r in page_links(pages).collect()}
    for i, (html, want) in enumerate(forms.items()):
        assert got.get(f"{page}#{i}") == want, html
