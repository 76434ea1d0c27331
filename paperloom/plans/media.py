"""Queries of figures, sheets, settings and candidates; shapes are made of order lines' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures, grids, registry
from ._registry import query

_IMAGES = """(SELECT l_orderkey AS file, l_linenumber * 100000 + l_partkey AS n, l_partkey % 700 AS width, l_suppkey * 13 % 900 AS height, CAST(l_extendedprice AS INT) AS n_bytes, l_partkey % 50 AS content_hash, l_quantity AS x1, l_quantity * 2 AS y1 FROM lineitem)"""


@query(
    f"""SELECT file, n, count(*) AS rows, bool_or(large AND n = first AND NOT (x1 / 1000 < 0.05 AND y1 / 1000 < 0.05) AND NOT (greatest(width, height) / greatest(least(width, height), 1) > 12) AND NOT (n_bytes / (width * height) < 0.08 AND width * height < 500000)) AS kept
    FROM (SELECT *, min(CASE WHEN large THEN n END) OVER (PARTITION BY file, content_hash) AS first FROM (SELECT *, width >= 100 AND height >= 100 AND width * height >= 30000 AND n_bytes >= 2048 AS large FROM {_IMAGES})) GROUP BY file, n"""
)
def kept_images(t):
    rows = t("lineitem").selectExpr("l_orderkey as file", "l_linenumber * 100000 + l_partkey as n", "l_partkey % 700 as width", "l_suppkey * 13 % 900 as height", "cast(rint(l_extendedprice) as int) as n_bytes", "l_partkey % 50 as content_hash", "0 as x0", "0 as y0", "l_quantity as x1", "l_quantity * 2 as y1", "1000 as page_width", "1000 as page_height")
    return figures.kept_images(rows, ["n"]).groupBy("file", "n").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))


_CELLS = "(SELECT o_orderstatus AS sheet, o_orderkey % 40 + 1 AS row, o_custkey % 6 + 1 AS col, max(CASE WHEN o_custkey % 6 < 3 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END) AS value FROM orders GROUP BY ALL)"


@query(
    f"""SELECT sheet, string_agg(mark, ' ' ORDER BY col) AS separators FROM (SELECT sheet, col, CASE WHEN bool_or(value IS NOT NULL) AND bool_and(value IS NULL OR regexp_full_match(value, '[+-]?[0-9]+([.][0-9]*)?')) THEN '---:' ELSE '---' END AS mark
    FROM (SELECT s.sheet, s.col, c.value FROM (SELECT sheet, row, unnest(range(c0, c1 + 1)) AS col FROM (SELECT sheet, unnest(range(min(row) + 1, max(row) + 1)) AS row, min(col) AS c0, max(col) AS c1 FROM {_CELLS} GROUP BY sheet)) s LEFT JOIN {_CELLS} c USING (sheet, row, col)) GROUP BY ALL) GROUP BY sheet"""
)
def sheet_alignments(t):
    """Which columns of a sheet (orders of a status, dealt to rows and columns) are numbers."""
    numeric = F.col("o_custkey") % 6 < 3
    cells = t("orders").groupBy(F.col("o_orderstatus").alias("sheet"), (F.col("o_orderkey") % 40 + 1).cast("int").alias("row"), (F.col("o_custkey") % 6 + 1).cast("int").alias("col"))
    cells = cells.agg(F.max(F.when(numeric, F.col("o_orderkey").cast("string")).otherwise(F.col("o_orderpriority"))).alias("value"))
    return grids.alignments(grids.rows_of(grids.filled(cells))).select("sheet", F.array_join("separators", " ").alias("separators"))


@query("SELECT query_id, provider, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, provider, candidate_id) AS rank FROM (SELECT 'a' AS provider, p_size AS query_id, p_partkey AS candidate_id, p_retailprice AS score FROM part UNION ALL SELECT 'b', s_nationkey, s_suppkey, s_acctbal / 5 FROM supplier)) WHERE rank <= 8")
def merged_candidates(t):
    a = t("part").selectExpr("cast(p_size as long) as query_id", "cast(p_partkey as long) as candidate_id", "cast(p_retailprice as double) as score", "true as valid")
    b = t("supplier").selectExpr("cast(s_nationkey as long) as query_id", "cast(s_suppkey as long) as candidate_id", "cast(s_acctbal / 5 as double) as score", "true as valid")
    return registry.merged_candidates({"a": a, "b": b}).select("query_id", "provider", "candidate_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT o_custkey AS slide, o_orderpriority AS grp FROM orders WHERE o_custkey % 3 <> 0 AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def dangling_references(t):
    o = t("orders").select(F.col("o_custkey").alias("slide"), F.col("o_orderpriority").alias("group"), "o_orderstatus")
    config, targets = o.where("slide % 3 != 0").select("slide", "group"), o.where("o_orderstatus = 'F'").select("slide", "group").distinct()
    return registry.dangling_references(config, targets).select("slide", F.col("group").alias("grp"))


@query("SELECT c_custkey, region, r_regionkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'first' WHEN c_custkey % 7 = 1 THEN 'nowhere' ELSE lower(r_name) END AS region FROM customer JOIN (SELECT r_regionkey AS k, r_name FROM region) ON c_custkey % 5 = k) LEFT JOIN region ON CASE WHEN region = 'first' THEN (SELECT lower(r_name) FROM region WHERE r_regionkey = 0) ELSE region END = lower(r_name)")
def settings_lookup(t):
    """Settings of a region by its name, whatever its case, or by an alias."""
    regions = t("region").select(F.lower("r_name").alias("name"), "r_regionkey")
    first = regions.where("r_regionkey = 0").first()[0]
    k = F.col("c_custkey")
    asked = t("customer").join(t("region").select(F.col("r_regionkey").alias("k"), "r_name"), k % 5 == F.col("k")).select("c_custkey", F.when(k % 7 == 0, "first").when(k % 7 == 1, "nowhere").otherwise(F.lower("r_name")).alias("region"))
    return registry.settings_for(asked, "region", regions, {"first": first}).select("c_custkey", "region", "r_regionkey")
