"""Rectangles that meet: against all pairs, on pages of many boxes, inclusive bounds, odd sides."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import regions as R

SCHEMA = "page int, k int, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n, pages=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        size = 2 ** rng.uniform(-3, 9)
        x, y = rng.randint(-300, 300), rng.randint(-300, 300)
        out.append((rng.randrange(pages), k, float(x), float(y), float(x + int(size)), float(y + int(size * rng.random()))))
    return out


def meet(a, b):
    return a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]


def test_every_pair_once(spark):
    a, b = boxes(1, 160), boxes(2, 160) + [(None, 900, 0.0, 0.0, 1.0, 1.0), (0, 901, 5.0, 0.0, 4.0, 1.0), (0, 902, None, 0.0, 4.0, 1.0)]
    for least in (0.5, 4.0, 1000.0):
        got = [(r.page, r.a.k, r.b.k) for r in R.meeting(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "page", least).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(x[0], x[1], y[1]) for x in a for y in b if y[1] < 900 and meet(x, y)}


def test_points_on_borders_and_open_regions(spark):
    points = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 8_000_000.0, 10.0), (0, 3, 12_192_000.0, 6_858_000.0), (1, 4, 1.0, 1.0)], "page int, p int, x double, y double")
    rows = [(0, n, *map(float, s)) for n, s in R.LAYOUTS["left_right"].items()] + [(0, "all", None, None, None, None), (1, "low", None, 0.0, None, None)]
    regions = spark.createDataFrame(rows, "page int, region string, x0 double, x1 double, y0 double, y1 double")
    got = {(r.p, r.region) for r in R.in_regions(points, regions, "page", "x", "y", 1000.0).collect()}
    assert got == {(1, "left"), (2, "left"), (2, "right"), (3, "right"), (1, "all"), (2, "all"), (3, "all")}


def test_uncovered_blocks(spark):
    blocks = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.0, 0.0, 10.0, 10.0), (0, 3, 20.0, 0.0, 30.0, 10.0), (0, 4, 5.0, 5.0, 5.0, 9.0), (1, 5, 0.0, 0.0, 10.0, 10.0), (0, 6, None, 0.0, 1.0, 1.0)], SCHEMA)
    covers = spark.createDataFrame([(0, 9, 0.0, 0.0, 10.0, 7.0), (0, 9, 20.0, 0.0, 30.0, 6.0)], SCHEMA)
    assert sorted(r.k for r in R.uncovered(blocks, covers, "page").collect()) == [3, 4, 5, 6]


def test_a_page_of_many_boxes(spark):
    many = spark.range(100_000).select(F.lit(0).alias("page"), F.col("id").cast("int").alias("k"), F.col("id").cast("double").alias("x0"), (F.col("id") % 317 * 10).cast("double").alias("y0"), (F.col("id") + 3).cast("double").alias("x1"), (F.col("id") % 317 * 10 + 5).cast("double").alias("y1"))
    began = time.time()
    assert R.meeting(many, many, "page", 4.0).count() == 100_000
    assert time.time() - began < 120


@pytest.mark.parametrize("set_to", [{}, {"BROADCAST": 0, "CHUNK": 2}, {"POINT": 0, "MOVED": 0, "PIECE": 10**4}])
def test_points_in_regions_of_unlike_sizes(spark, monkeypatch, set_to):
    for name, value in set_to.items():
        monkeypatch.setattr(R, name, value)
    rng = random.Random(5)
    odd = [math.inf, -math.inf, math.nan, None, 0.0, 999.0]
    points = [(str(rng.randrange(3)), k, float(rng.randrange(1000)), float(rng.randrange(1000))) for k in range(400)]
    points += [(page, 1000 + k, *rng.sample(odd, 2)) for k, page in enumerate([*"000111222", None])]
    regions = [(str(p), k, *[None if rng.random() < 0.1 else s for s in (x0, x1, y0, y1)]) for p, k, x0, y0, x1, y1 in boxes(6, 200)] + [("0", 900, 50.0, 40.0, 0.0, 9.0), (None, 901, 0.0, 9.0, 0.0, 9.0), ("2", 902, -9e9, -8e9, 0.0, 9.0), ("1", 903, None, None, None, None), ("2", 904, 3.0, math.inf, 5.0, None)]
    over = lambda a, b: math.isnan(a) or a >= b if not math.isnan(b) else math.isnan(a)
    within = lambda v, low, high: v is not None and (low is None or over(v, low)) and (high is None or over(high, v))
    valid = lambda low, high: low is None or high is None or low <= high
    want = sorted((p[1], r[1]) for p in points for r in regions if p[0] is not None and p[0] == r[0] and valid(*r[2:4]) and valid(*r[4:]) and within(p[2], *r[2:4]) and within(p[3], *r[4:]))
    df = R.in_regions(spark.createDataFrame(points, "page string, p int, x double, y double"), spark.createDataFrame(regions, "page string, region int, x0 double, x1 double, y0 double, y1 double"), "page", "x", "y")
    assert df.columns == ["page", "p", "x", "y", "region"]
    assert sorted((r.p, r.region) for r in df.collect()) == want


def test_points_stay_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.range(20_000).selectExpr("0 as page", "id as p", "id * 7919 % 100000 as x", "id * 104729 % 100000 as y")
        regions = spark.range(300).selectExpr("0 as page", "id as region", "id * 311.0 as x0", "id * 311.0 + shiftleft(1, cast(id % 17 as int)) as x1", "id * 97.0 as y0", "id * 97.0 + shiftleft(1, cast(id % 13 as int)) as y1")
        df = R.in_regions(points, regions, "page", "x", "y")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert df.count() == points.crossJoin(regions.drop("page")).where("x between x0 and x1 and y between y0 and y1").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_points_and_no_regions(spark):
    points, regions = spark.range(3).selectExpr("0 as page", "id as p", "id as x", "id as y"), spark.range(1).selectExpr("0 as page", "id as region", "0 as x0", "9 as x1", "0 as y0", "9 as y1")
    assert [R.in_regions(p, r, "page", "x", "y").count() for p, r in ((points, regions), (points.limit(0), regions), (points, regions.limit(0)))] == [3, 0, 0]
