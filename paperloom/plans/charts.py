"""Queries of chart and box geometry over sales series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as L
from ._registry import query

_AREA = (100.0, 50.0, 1180.0, 620.0)
_SERIES = "(SELECT grp, idx, value, sum(value) OVER (PARTITION BY grp) AS total, max(value) OVER (PARTITION BY grp) * 1.1 AS top, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT o_orderstatus AS grp, CAST(substr(o_orderpriority, 1, 1) AS INT) AS idx, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2))"


def _series(t):
    rows = t("orders").groupBy(F.col("o_orderstatus").alias("grp"), F.substring("o_orderpriority", 1, 1).cast("int").alias("idx")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return rows


@query(f"SELECT grp, idx, round(100 + (1080 - (n * 50 + (n - 1) * 15.0)) / 2 + (idx - 1) * 65.0, 1) AS x, round(620 - value / top * 570, 1) AS y, CAST(50 AS DOUBLE) AS width, round(value / top * 570, 1) AS height, round(100 + (1080 - (n * 50 + (n - 1) * 15.0)) / 2 + (idx - 1) * 65.0 + 25, 1) AS label_x, CAST(650 AS DOUBLE) AS label_y FROM {_SERIES}")
def bar_chart(t):
    return L.bars(_series(t), "grp", _AREA)


@query(f"SELECT grp, idx, CAST(100 AS DOUBLE) AS x, round(50 + (570 - (n * 50 + (n - 1) * 15.0)) / 2 + (idx - 1) * 65.0, 1) AS y, round(value / top * 1080, 1) AS width, CAST(50 AS DOUBLE) AS height, CAST(90 AS DOUBLE) AS label_x, round(50 + (570 - (n * 50 + (n - 1) * 15.0)) / 2 + (idx - 1) * 65.0 + 25, 1) AS label_y FROM {_SERIES}")
def bar_chart_horizontal(t):
    return L.bars(_series(t), "grp", _AREA, horizontal=True)


_ANGLES = f"""(SELECT *, CASE WHEN b - a > 180 THEN 1 ELSE 0 END AS large_arc FROM (SELECT *, a + value / total * 360 AS b FROM
    (SELECT *, -90 + coalesce(sum(value) OVER (PARTITION BY grp ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total * 360 AS a FROM {_SERIES})))"""
_POINTS = "round(200 * cos(radians(a)), 2) AS start_x, round(200 * sin(radians(a)), 2) AS start_y, round(200 * cos(radians(b)), 2) AS end_x, round(200 * sin(radians(b)), 2) AS end_y"
_LABEL = "round(640 + 140 * cos(radians((a + b) / 2)), 1) AS label_x, round(360 + 140 * sin(radians((a + b) / 2)), 1) AS label_y"


@query(f"SELECT grp, idx, round(value / total * 100, 1) AS percentage, round(a, 1) AS start_angle, round(b, 1) AS end_angle, large_arc, {_POINTS}, {_LABEL} FROM {_ANGLES}")
def pie_chart(t):
    return L.slices(_series(t), "grp", 200.0, 640.0, 360.0).drop("path")


@query(f"SELECT grp, idx, {_POINTS}, large_arc, {_LABEL} FROM {_ANGLES}")
def donut_chart(t):
    """Slices of a ring; its outlines are in the unit tests."""
    return L.slices(_series(t), "grp", 200.0, 640.0, 360.0, inner=120.0).drop("path", "percentage", "start_angle", "end_angle")


@query(f"SELECT grp, idx, round(value / (top / 1.1) * 100, 1) AS percentage, round(a, 1) AS angle, round(r * cos(radians(a)), 2) AS x, round(r * sin(radians(a)), 2) AS y, round(640 + r * cos(radians(a)), 2) AS abs_x, round(360 + r * sin(radians(a)), 2) AS abs_y FROM (SELECT *, -90 + (idx - 1) * (360.0 / n) AS a, 200 * value / (top / 1.1) AS r FROM {_SERIES})")
def radar_chart(t):
    return L.radar(_series(t), "grp", 200.0, 640.0, 360.0)


@query(
    """SELECT grp, idx, round(CASE WHEN hi = lo THEN 100 ELSE 100 + (x - lo) / (hi - lo) * 1080 END, 1) AS svg_x, round(CASE WHEN top = 0 THEN 620 ELSE 620 + value / top * -570 END, 1) AS svg_y
    FROM (SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS idx, l_quantity AS x, l_extendedprice AS value, min(l_quantity) OVER (PARTITION BY l_suppkey) AS lo, max(l_quantity) OVER (PARTITION BY l_suppkey) AS hi, max(l_extendedprice) OVER (PARTITION BY l_suppkey) * 1.1 AS top FROM lineitem)"""
)
def line_chart(t):
    series = t("lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("value"))
    return L.line_points(series, "grp", _AREA)


@query(
    """SELECT n_nationkey, row, col, (row - 1) * c + col AS index, round(120 + (col - 1) * (w + 20), 1) AS x, round(70 + (row - 1) * (h + 20), 1) AS y, round(w, 1) AS width, round(h, 1) AS height, round(120 + (col - 1) * (w + 20) + w / 2, 1) AS cx, round(70 + (row - 1) * (h + 20) + h / 2, 1) AS cy FROM
    (SELECT n_nationkey, c, unnest(range(1, r + 1)) AS row, w, h FROM (SELECT n_nationkey, r, c, (1040 - (c - 1) * 20) / c AS w, (530 - (r - 1) * 20) / r AS h FROM (SELECT n_nationkey, n_nationkey % 4 + 1 AS r, n_nationkey % 3 + 1 AS c FROM nation))) JOIN (SELECT unnest(range(1, 4)) AS col) ON col <= c"""
)
def grid_layout(t):
    g = t("nation").select("n_nationkey", (F.col("n_nationkey") % 4 + 1).alias("r"), (F.col("n_nationkey") % 3 + 1).alias("c"))
    return L.grid(g, "n_nationkey", "r", "c", _AREA)


_IMAGES = "SELECT l_orderkey AS slide, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


@query(
    f"""SELECT slide, idx, 457200 + CASE n WHEN 1 THEN 0 WHEN 2 THEN (idx - 1) * (5547360 + 182880) WHEN 3 THEN CASE idx WHEN 3 THEN 5547360 + 182880 ELSE 0 END ELSE (idx - 1) % 3 * (3637280 + 182880) END AS x,
    914400 + 457200 + CASE WHEN n <= 2 THEN 0 WHEN n = 3 THEN CASE WHEN idx = 1 THEN 0 ELSE (5029200 - 182880) // 2 + 182880 END ELSE (idx - 1) // 3 * ((5029200 - (k - 1) * 182880) // k + 182880) END AS y,
    CASE WHEN n = 1 OR (n = 3 AND idx = 1) THEN 11277600 WHEN n <= 3 THEN 5547360 ELSE 3637280 END AS width, CASE WHEN n <= 2 THEN 5029200 WHEN n = 3 THEN (5029200 - 182880) // 2 ELSE (5029200 - (k - 1) * 182880) // k END AS height
    FROM (SELECT *, (n + 2) // 3 AS k FROM ({_IMAGES}))"""
)
def arranged_images(t):
    images = t("lineitem").select(F.col("l_orderkey").alias("slide"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("idx"))
    return L.arrange(images, "slide", 12_192_000, 6_858_000)


@query(
    """SELECT p_partkey, CASE WHEN on_top THEN 'top-bottom' ELSE 'left-right' END AS layout, CAST(CASE WHEN on_top THEN 1160 WHEN full_height THEN side ELSE 812 END AS INT) AS image_w, CAST(CASE WHEN on_top THEN top WHEN full_height THEN 560 ELSE least(round_even(812 / r, 0), 560) END AS INT) AS image_h,
    CAST(CASE WHEN on_top THEN 1160 WHEN full_height THEN 1160 - side - 20 ELSE 328 END AS INT) AS text_w, CAST(CASE WHEN on_top THEN 560 - top - 20 ELSE 560 END AS INT) AS text_h FROM
    (SELECT *, r > 1.5 AND 560 - top - 20 >= 150 AS on_top, r <= 1.5 AND 1160 - side - 20 >= 280 AS full_height FROM (SELECT p_partkey, r, round_even(1160 / r, 0) AS top, round_even(560 * r, 0) AS side FROM (SELECT p_partkey, p_size / 13.0::DOUBLE AS r FROM part)))"""
)
def layout_decision(t):
    found = L.text_beside_image(F.col("p_size") / 13.0, 1160, 560)
    return t("part").select("p_partkey", *[c.alias(k) for k, c in found.items()])


@query("SELECT a.l_orderkey, a.l_linenumber, coalesce(abs(a.l_quantity - b.l_quantity) <= 1 AND abs(a.l_tax - b.l_tax) <= 1, false) AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL) a LEFT JOIN (SELECT l_orderkey, l_linenumber - 1 AS l_linenumber, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL) b USING (l_orderkey, l_linenumber)")
def position_validation(t):
    found = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("x"), F.min("l_tax").alias("y"))
    want, got = found, found.withColumn("l_linenumber", F.col("l_linenumber") - 1)
    return L.validate_positions(want, got, ["l_orderkey", "l_linenumber"])
