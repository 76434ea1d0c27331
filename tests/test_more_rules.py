"""Manifests, coverage, project validation, clusters, figures and outliers by their rules."""

from pyspark.sql import functions as F

from paperloom.operators import dedup as G
from paperloom.operators import drawings as D
from paperloom.operators import gates as Q
from paperloom.operators import joins as J


def test_manifests_are_merged_in_order(spark):
    schema = "k string, o long, v string"
    old = spark.createDataFrame([("b", 1, "b0"), ("a", 2, "a0"), (None, 3, "x"), ("b", 4, "b1")], schema)
    new = spark.createDataFrame([("z", 1, "z1"), ("b", 2, "b8"), ("c", 3, "c1"), ("z", 4, "z2"), ("b", 5, "b9"), (None, 6, "n")], schema)
    got = [(r.k, r.v) for r in J.merged_manifest(old, new, "k", "o").orderBy("place").collect()]
    assert got == [("b", "b9"), ("a", "a0"), ("b", "b9"), ("z", "z2"), ("c", "c1")]


def test_coverage(spark):
    source = spark.createDataFrame([(2, "b a"), (1, "a c c b d " + "x " * 100_001 + "late")], "i long, t string")
    pages = spark.createDataFrame([("the c",), ("X",), (None,)], "t string")
    tokens = F.split(F.lower("t"), " ")
    found = Q.keyword_coverage(source, "i", F.filter(tokens, lambda w: w != ""), pages, tokens, most=5)
    assert [(r.place, r.tok, r.covered) for r in found.orderBy("place").collect()] == [(1, "x", True), (2, "a", False), (3, "c", True), (4, "b", False), (5, "d", False)]
    assert tuple(Q.coverage_summary(found).first()) == (2, 5, ["a", "b", "d"], 0.4)
    assert Q.coverage_summary(found.where("false")).first().coverage_rate is None


def test_projects(spark):
    rows = [("a", 0, 0, 0, True, True), ("a", 1, 5, 0, False, True), ("b", 0, 1, 0, True, False), ("b", 0, 0, 2, True, True), (None, 0, 0, 0, True, True)]
    df = spark.createDataFrame(rows, "format string, errors int, warnings int, drawing_warnings int, has_readme boolean, has_spec boolean")
    got = {(r.format, r.all_formats): tuple(r)[1:8] for r in Q.project_validation(df).collect()}
    assert got == {("a", False): (2, 1, 1, 0, 1, 0, 0), ("b", False): (2, 0, 0, 2, 0, 1, 1), (None, False): (1, 1, 0, 0, 0, 0, 0), (None, True): (5, 2, 1, 2, 1, 1, 1)}


def test_clusters(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.05]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.7, 0.7]), (5, [1.0, 0.0]), (6, None)]
    found = G.greedy_clusters(spark.createDataFrame(v, "vec_id long, embedding array<double>"), 0.95)
    assert {r.vec_id: (r.kept, r.cluster) for r in found.collect()} == {0: (True, 0), 1: (False, 0), 2: (True, 2), 3: (False, 2), 4: (True, 4), 5: (False, 0), 6: (True, 6)}
    s = G.removal_statistics(found).first()
    assert (s.total, s.kept, s.removed, s.clusters, s.largest) == (7, 4, 3, 2, 3) and abs(s.removal_rate - 300 / 7) < 1e-9
    assert {r.cluster: r["size"] for r in G.cluster_sizes(found).collect()} == {0: 3, 2: 2}
    assert G.removal_statistics(found.where("false")).first().total == 0


def test_figures_in_reading_order(spark):
    rects = [(1, 1, 300.0, 500.0, 300.0, 200.0), (1, 2, 0.0, 0.0, 300.0, 200.0), (1, 3, 310.0, 510.0, 250.0, 180.0), (1, 4, 0.0, 0.0, 99.0, 900.0), (1, 5, 0.0, 700.0, 900.0, 100.0), (1, 6, 0.0, 900.0, 170.0, 170.0), (1, 7, 400.0, 0.0, 300.0, 200.0), (2, 8, 0.0, 0.0, 200.0, 200.0)]
    tables = spark.createDataFrame([(1, 390.0, 0.0, 200.0, 210.0)], "page int, x double, y double, w double, h double")
    df = spark.createDataFrame(rects, "page int, k long, x double, y double, w double, h double")
    got = {(r.page, r.k): r.place for r in G.figure_rectangles(df, "page", "k", tables).collect()}
    assert got == {(1, 2): 1, (1, 1): 2, (2, 8): 1}


def test_footnotes_are_no_outliers(spark):
    rows = [("p", n, "solar power wind power grid solar wind", 10, 20) for n in range(8)] + [("p", 8, "zebra quilt", 10, 20), ("p", 9, "footnote xyz", 6_000_000, 9), ("p", 10, "large low", 6_000_000, 14), ("q", 1, "a b", 0, 9), ("q", 2, "c d", 0, 9)]
    df = spark.createDataFrame(rows, "p string, n int, t string, top long, size int")
    got = {r.n for r in G.outliers(df, ["p"], "n", F.split("t", " "), F.col("top"), F.col("size")).where("outlier and critical").collect()}
    assert got == {8, 10}


def test_report_of_drawings(spark):
    rows = [("ok",), ("warn",), ("bad bad",), ("bad",), ("warn bad",)]
    rules = [("viewbox_missing", D.ERROR, F.col("t").contains("bad")), ("script", D.ERROR, F.col("t").contains("bad bad")), ("long_text", D.WARNING, F.col("t").contains("warn"))]
    df = spark.createDataFrame(rows, "t string")
    got = {(r.kind, r.name): (r.n, r.percent) for r in D.check_report(df, rules).collect()}
    assert got == {("total", "drawings"): (5, 100), ("result", "passed"): (1, 20), ("result", "warnings"): (1, 20), ("result", "errors"): (3, 60), ("category", "viewBox issues"): (3, None), ("category", "Other"): (1, None)}
    assert [tuple(r) for r in D.check_report(df.where("false"), rules).collect()] in ([], [("total", "drawings", 0, None)])
