"""Crawling: references against the standard library's, filters, visited addresses, the best folders."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from paperloom.operators import crawl as W


def test_references_resolve_as_the_standard_library_does(spark):
    bases = ["http://h.org", "http://h.org/", "https://h.org/a/b", "https://h.org/a/b/", "https://h.org/a/b/c.html?q=/x/#f"]
    refs = ["", "x", "./x", "../x", "../../x/", "../../../../x", "..", ".", "./", "../", "a/./b/../c", "/x", "/a/../x/.", "//o.net/p", "?k=v", "#f", "ftp://z/x", "x?y=../z", "x#../y", "a/..", "mailto:a@b"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", W.resolved(F.col("b"), F.col("r")).alias("got")).collect():
        assert row.got == urljoin(row.b, row.r), (row.b, row.r)


def page(url, *refs):
    return (url, "".join(f'<a title=1 HREF="{r}">x</a>' for r in refs))


def test_levels_filters_and_visited(spark):
    base = "http://h/d/"
    pages = [
        page(base, "A.pptx", "b/", "c", "../up/", "z.pdf", "d.html", "#x", "javascript:f()", "b/", "e.html/"),
        page(base + "b/", "Plan%20X.ppt", "../", "../c", "b2/"),
        page(base + "c", "plan.ppt", "c/more"),  # a sibling's name isn't below it; a longer one is
        page(base + "b/b2/", "deep.pptx"),
        page(base + "e.html/", "plan.pptx"),
    ]
    p = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([(base,), ("http://none/",), (None,)], "url string")
    got = lambda **k: sorted((r.link, r.level) for r in W.crawl(p, seeds, **k).collect())
    assert got(depth=1) == [(base + "A.pptx", 0)]
    assert got(depth=2) == [(base + "A.pptx", 0), (base + "b/Plan%20X.ppt", 1), (base + "e.html/plan.pptx", 1), (base + "plan.ppt", 1)]
    assert (base + "b/b2/deep.pptx", 2) in got(depth=5)
    assert got(depth=2, keywords=("PLAN x",)) == [(base + "b/Plan%20X.ppt", 1)]
    assert got(depth=2, most=1) == [(base + "A.pptx", 0), (base + "b/Plan%20X.ppt", 1)]
    assert W.crawl(p.where("false"), seeds).count() == 0


def test_circles_end(spark):
    p = spark.createDataFrame([page("http://h/a/", "/a/b/"), page("http://h/a/b/", "/a/b/", "/a/", "f.ppt")], "url string, html string")
    assert [tuple(r) for r in W.crawl(p, p.limit(1), depth=6).collect()] == [("http://h/a/", "http://h/a/b/f.ppt", 1)]
