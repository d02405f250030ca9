from docgrid.llm.components import components
from docgrid.llm.url_filter import filter_urls, html_edges

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))


def judge(spark, rows, edges=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    return {r.id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, RULES, html_edges(pages) if edges is None else edges).collect()}


def test_rules(spark):
    got = judge(spark, [(1, "http://A.Example.com/en/x?q#f", None, "h"), (2, "https://www.example.com/en/", "", None), (3, "http://www.example.com", None, None), (4, "//x", None, None), (5, None, None, None), (6, "http://b.net/es/1", None, None), (7, "http://notexample.com/en/", None, None), (8, "http://h?x/y", None, None), (9, "http://p.org/a/b?c://d", None, None), (10, "", None, None)])
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("www.example.com", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("b.net", "/es/1", "net/es/", "block"), 7: ("notexample.com", "/en/", "com/", "allow"), 8: ("h", "", None, "allow"), 9: ("p.org", "/a/b", None, "allow"), 10: ("", "", None, "allow"),
    }


def test_aliases(spark):
    link = '<link href="%s" rel="canonical">'
    rows = [
        (1, "http://a.org/1", link % "http://b.org/2", None), (2, "http://b.org/2", '<META http-equiv="refresh" content="0; url=http://c.net/es/3">', None), (3, "http://d.org/1", link % "/2", None),
        (4, "http://d.org/2", link % "http://c.net/es/9", None), (5, "http://d.org/3", link % "http://d.org/2", None), (6, "http://e.com/x", link % "http://d.org/1", None), (7, "http://z.org/", link % "http://z.org/", None), (7, "http://z.org/", None, None),
    ]
    got = {k: v[3] for k, v in judge(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}  # 6 is allowed, so its component is
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert filter_urls(empty, RULES, html_edges(empty)).count() == 0


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(999, i) for i in range(500, 560)] + [(700, 700), (None, 5), (5, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long"))[0].count() == 0


def test_relative_and_double_links(spark):
    from urllib.parse import urljoin

    link, refresh = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    page = "http://d.org/a/b/c.html?q=1"
    targets = ["page2.html", "../x", "?id=3", "./y", "../../..", "../../z/./w?k=../v", "/r/../s", "//e.org/t", "http://f.org/u", "/go?to=http://g.org/", "..", "."]
    rows = [(i, page, link % t) for i, t in enumerate(targets)] + [(50, "http://h.org", link % "top.html"), (51, page, '<base href="/base/dir/">' + link % "p"), (52, page, link % "mailto:x"), (53, "nowhere", link % "p"), (54, None, link % "p"), (55, page, None)]
    rows += [(56, "http://two.org/", link % "one" + refresh % "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(page, urljoin(page, t)) for t in targets] + [("http://h.org", "http://h.org/top.html"), (page, "http://d.org/base/dir/p"), ("http://two.org/", "http://two.org/one"), ("http://two.org/", "http://two.org/two")]
    assert sorted(tuple(r) for r in html_edges(pages).collect()) == sorted(want)
    rows = [
        (1, "http://a.org/x/1", refresh % "2", None), (2, "http://a.org/x/2", link % "http://b.net/es/", None), (3, "http://c.org/1", link % "/2" + refresh % "http://b.net/es/", None),
        (4, "http://c.org/2", "", None), (5, "http://k.org/1", link % "http://b.net/es/9" + refresh % "http://k.com/", None),
    ]
    assert {k: v[3] for k, v in judge(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_urls_that_are_the_same_page(spark):
    from pyspark.sql import functions as F

    from docgrid.llm.url_filter import url_node

    given = ["HTTP://Plain.ORG/A?b#c", "http://plain.org:80/A?b", "https://x.org:443", "https://x.org/", "http://x.org:8080/", "http://x.org:", "mailto:a#b", "nowhere", None]
    got = [r.n for r in spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string").select("i", url_node(F.col("u")).alias("n")).orderBy("i").collect()]
    assert got == ["http://plain.org/A?b", "http://plain.org/A?b", "https://x.org/", "https://x.org/", "http://x.org:8080/", "http://x.org/", "mailto:a", "nowhere", None]
    pages = [(1, "http://Plain.org/a", "x", None), (2, "http://plain.org:80/a#top", None, None), (3, "http://plain.org/b", None, None)]
    edges = spark.createDataFrame([("http://plain.org/a", "http://bad.net/es/#x")], "source string, target string")
    assert {k: v[3] for k, v in judge(spark, pages, edges).items()} == {1: "block", 2: "block", 3: "allow"}


def test_hub_and_very_long_html(spark):
    rows = [(i, f"http://h.org/{i}", '<link rel="canonical" href="/hub">' + ("<p>" * 300_000 if i == 3 else ""), None) for i in range(300)]
    rows += [(900, "http://h.org/hub", '<meta http-equiv="refresh" content="0;url=http://c.net/es/1">', None)]
    assert {v[3] for v in judge(spark, rows).values()} == {"block"}
