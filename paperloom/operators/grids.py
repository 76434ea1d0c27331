"""Sheets of cells as tables: bounds, merged ranges, padding, and Markdown.

A sheet is (sheet, row, col, value) with a row for each cell that has a value; numbers of rows and columns start
at 1. Nothing is held but a row of cells at a time: bounds are aggregates, merged ranges are exploded and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def filled(cells: DataFrame, merged: DataFrame | None = None, sheet: str = "sheet") -> DataFrame:
    """(sheet, row, col, value): the cells with a value; each empty cell of a merged range has that of its first cell, if it has one.

    ``merged``: (sheet, row0, col0, row1, col1). Of ranges that overlap, the last in order gives the value.
    """
    own = cells.select(sheet, "row", "col", "value").where(~is_empty(F.col("value")))
    if merged is None:
        return own
    head = own.select(sheet, F.col("row").alias("row0"), F.col("col").alias("col0"), "value")
    spread = merged.join(head, [sheet, "row0", "col0"])
    spread = spread.select("*", F.explode(F.sequence("row0", "row1")).alias("row")).select("*", F.explode(F.sequence("col0", "col1")).alias("col"))
    given = spread.groupBy(sheet, "row", "col").agg(F.max_by("value", F.struct("row0", "col0")).alias("given"))
    both = own.join(given, [sheet, "row", "col"], "full_outer")
    return both.select(sheet, "row", "col", F.coalesce("value", "given").alias("value"))


def rows_of(cells: DataFrame, sheet: str = "sheet", max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """(sheet, row, cells, rows_truncated, cols_truncated): each row between the bounds, as wide as the widest; 0 for no limit."""
    ends = cells.groupBy(sheet).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    limit = lambda low, high, most: F.least(F.col(high), F.col(low) + most - 1) if most else F.col(high)
    ends = ends.select(sheet, "_r0", "_c0", limit("_r0", "_r1", max_rows).alias("_rl"), limit("_c0", "_c1", max_cols).alias("_cl"), (F.col("_r1") > limit("_r0", "_r1", max_rows)).alias("rows_truncated"), (F.col("_c1") > limit("_c0", "_c1", max_cols)).alias("cols_truncated"))
    inside = cells.join(ends, sheet).where("row <= _rl and col <= _cl")
    width = inside.groupBy(sheet).agg(F.max(F.col("col") - F.col("_c0") + 1).alias("_w"))
    found = inside.groupBy(sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct((F.col("col") - F.col("_c0")).alias("k"), F.col("value").alias("v")))).alias("_m"))
    every = ends.join(width, sheet).select("*", F.explode(F.sequence("_r0", "_rl")).alias("row")).join(found, [sheet, "row"], "left")
    values = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit("")))
    return every.select(sheet, "row", values.alias("cells"), "rows_truncated", "cols_truncated")


NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def alignments(rows: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, separators): for each column ``---:`` if it has values below the first row (or in a single one) and all are numbers, else ``---``."""
    w = Window.partitionBy(sheet)
    data = rows.withColumn("_first", F.min("row").over(w)).withColumn("_n", F.count("*").over(w)).where("row > _first or _n = 1")
    each = data.select(sheet, F.posexplode("cells").alias("col", "value"))
    kind = each.groupBy(sheet, "col").agg(F.max(F.when(~is_empty(F.col("value")), 1).otherwise(0)).alias("any"), F.min(F.when(is_empty(F.col("value")) | F.trim("value").rlike(NUMBER), 1).otherwise(0)).alias("all"))
    mark = F.when((F.col("any") == 1) & (F.col("all") == 1), "---:").otherwise("---")
    return kind.groupBy(sheet).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", mark.alias("m")))), lambda x: x["m"]).alias("separators"))


def cell_text(value: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.replace(F.regexp_replace(F.trim(value), "[\r\n]+", "<br>"), F.lit("|"), F.lit("\\|"))


def line_of(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_tables(rows: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, markdown): a table of each sheet, whose first row is its head."""
    lines = rows.groupBy(sheet).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", line_of(F.transform("cells", cell_text)).alias("l")))), lambda x: x["l"]).alias("lines"))
    both = lines.join(alignments(rows, sheet), sheet)
    text = F.array_join(F.concat(F.slice("lines", 1, 1), F.array(line_of(F.col("separators"))), F.expr("slice(lines, 2, size(lines))")), "\n")
    return both.select(sheet, text.alias("markdown"))
