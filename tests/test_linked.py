"""Geometric clusters by batches of groups, held against a search of each group."""

import numpy as np

from paperloom.operators import dedup as G


def test_groups_of_all_sizes(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 14, 400)
    sizes[[3, 200]] = 60, 700
    start, n = np.cumsum(sizes) - sizes, sizes.sum()
    x, y = rng.integers(0, 120, n).astype(float), rng.integers(0, 120, n).astype(float)
    monkeypatch.setattr(G, "PAIRS", 500)
    got = G.linked_rows(start, sizes, x, y, 25)
    for a, k in zip(start, sizes, strict=True):
        assert (got[a : a + k] == a + G._linked(x[a : a + k], y[a : a + k], 25)).all()


def test_small_groups_share_tasks(spark):
    rows = [(g, k, 10.0 * k * (1 + g % 3), 0.0, float(k)) for g in range(50) for k in range(4)]
    found = G.geometric_clusters(spark.createDataFrame(rows, "g long, k int, x double, y double, a double"), "g", "k", "x", "y", "a", 15)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {(r.g, r.k): r.cluster for r in found.collect()}
    # one cluster where steps are 10; else the largest area first
    assert got == {(g, k): 1 if g % 3 == 0 else 4 - k for g in range(50) for k in range(4)}


def test_thin_boxes_are_cut_along_their_longer_side(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import regions as R

    rng = np.random.default_rng(3)
    box = lambda n, w, h: [(0, k, float(x), float(y), float(x + rng.integers(0, w)), float(y + rng.integers(0, h))) for k, (x, y) in enumerate(rng.integers(0, 5000, (n, 2)))]
    a, b = box(80, 4000, 9) + box(80, 9, 4000) + box(40, 300, 300), box(60, 4000, 30) + box(60, 40, 40)
    kind = "p int, k long, x0 double, y0 double, x1 double, y1 double"
    left, right = (spark.createDataFrame([(r[0], n, *r[2:]) for n, r in enumerate(rows)], kind) for rows in (a, b))
    got = sorted(tuple(r) for r in R.meeting(left, right, "p", 4).select("a.k", F.col("b.k").alias("j")).collect())
    assert got == sorted((i, j) for i, s in enumerate(a) for j, t in enumerate(b) if s[2] <= t[4] and t[2] <= s[4] and s[3] <= t[5] and t[3] <= s[5])
    thin = spark.createDataFrame([(0, 1, 0.0, 0.0, 6e6, 1000.0)], kind)
    assert R._levelled(thin, "p", "a", 4096).first().alevel == 5


def test_tokens_and_keywords_are_made_once(spark, tmp_path):
    from paperloom import plans

    spark.createDataFrame([(1, "Ab ab  x\ty 12 12 ...")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, most in (("search_token_sets", {"regexp_replace(": 1, "regexp_extract_all(": 4}), ("keyword_runs", {"array_distinct(": 2})):
        df = plans.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all(plan.count(text) <= times for text, times in most.items()), plan
        assert df.count() == 1


def test_similar_floats_by_slices(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    monkeypatch.setattr(G, "SLICE", 7)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    product = v.astype(float) @ v.astype(float).T
    assert G.BLOCK >= 8192
    for block in (20, 2048):
        got = {tuple(r) for r in G.similar_pairs(rows, 2.0, block=block).collect()}
        assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if product[i, j] > 2.0}


def test_headings_of_many_documents_share_tasks(spark):
    from paperloom.operators import structure as S

    rows = [(d, n, level, "h" * 20) for d in range(30) for n, level in enumerate((1, 1, 1, 0, 0, 2, 1))]
    found = S.merged_headings(spark.createDataFrame(rows, "d long, n int, level int, t string"), "d", "n", "level", "t")
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    h = "h" * 20
    one = [(0, 1, f"{h} {h}"), (2, 1, h), (3, 0, h), (4, 0, h), (5, 2, h), (6, 1, h)]
    assert sorted(tuple(r) for r in found.collect()) == [(d, *r) for d in range(30) for r in one]
