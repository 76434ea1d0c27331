"""Segmented scans: running values over the ordered rows of a key, however many of all rows one key has.

A window over a key is one task. Here the rows of a key of more than ``ROWS`` are cut into order ranges by approximate percentiles of an order column,
windows run in each range, and a range's *summary* (first and last value, how many islands begin, how deep undos reach) goes on to the ranges after
it by a scan over summaries, of which a key has ``RANGES`` at most. Summaries need no exchange of their own: rows are dealt by (key, range) once.
Keys of fewer rows have one range. Rows that tie in the cut column stay in one range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..state import stored

#: Rows of a key that a task takes at once, and ranges of a key at most.
ROWS, RANGES = 1 << 20, 1024
_KEY, _RANGE = "_scan_key", "_scan_range"


class Ranges:
    """Rows with a key and a range, the windows over one range, and over a key's summaries."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str], cut: str | None = None, most: int = ROWS):
        # as a struct, keys are compared with their nulls, by joins too
        rows = rows.withColumn(_KEY, F.struct(*key))
        at = cut or order[0]
        large = rows.groupBy(_KEY).agg(F.count("*").alias("n")).where(F.col("n") > most)
        most_rows = large.agg(F.max("n")).first()[0]
        self.split = most_rows is not None
        if self.split:
            ranges = min(RANGES, -(-most_rows // most))
            shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
            # ranges hold nulls of the cut column first, as the order does
            cuts = rows.join(large, _KEY, "left_semi").groupBy(_KEY).agg(F.array_distinct(F.percentile_approx(F.col(at), shares, F.lit(20 * ranges))).alias("_cuts"))
            rows = rows.join(stored(cuts), _KEY, "left")
            before = F.size(F.filter("_cuts", lambda c: c < F.col(at)))
            rows = rows.withColumn(_RANGE, F.when(F.col("_cuts").isNull() | F.col(at).isNull(), -1).otherwise(before)).drop("_cuts")
        else:
            rows = rows.withColumn(_RANGE, F.lit(-1))
        self.rows = rows
        #: A row's place: structs are compared as the order is, nulls first.
        self.place = F.struct(*order)
        self.here = Window.partitionBy(_KEY, _RANGE).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        self.so_far = self.here.rowsBetween(Window.unboundedPreceding, 0)
        self.to_come = self.here.rowsBetween(1, Window.unboundedFollowing)
        #: Over a key's summaries.
        self.in_order = Window.partitionBy(_KEY).orderBy(_RANGE)
        self.all_before = self.in_order.rowsBetween(Window.unboundedPreceding, -1)
        self.all_after = self.in_order.rowsBetween(1, Window.unboundedFollowing)

    def summed_up(self, rows: DataFrame, **aggregates: Column) -> DataFrame:
        """A row for each range of a key; rows are dealt by both already."""
        return rows.groupBy(_KEY, _RANGE).agg(*(c.alias(name) for name, c in aggregates.items()))

    def with_carry(self, rows: DataFrame, carry: DataFrame, *columns: str) -> DataFrame:
        """The rows with what their range gets from the key's other ranges."""
        return rows.join(carry.select(_KEY, _RANGE, *columns), [_KEY, _RANGE])

    def done(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.drop(_KEY, _RANGE, *more)


def numbered(rows: DataFrame, group: list[str], order: list[str], values: list[str], starts: Callable[[Column, Column], Column], name: str, first: int = 1, most: int = ROWS) -> DataFrame:
    """Numbers runs of a group's rows in order: a row begins a new one where ``starts(before, now)`` holds, of two neighbours' ``values`` as structs."""
    r = Ranges(rows, group, order, most=most)
    rows = r.rows.withColumn("_now", F.struct(*values))
    rows = rows.withColumn("_before", F.lag("_now").over(r.here))
    rows = rows.withColumn("_new", F.when(F.col("_before").isNotNull() & starts(F.col("_before"), F.col("_now")), 1).otherwise(0))
    rows = rows.withColumn(name, F.sum("_new").over(r.so_far) + first)
    if r.split:
        of = r.summed_up(rows, _head=F.min_by("_now", r.place), _tail=F.max_by("_now", r.place), _runs=F.sum("_new")).withColumn("_end", F.lag("_tail").over(r.in_order))
        # a range's first row begins a run or not by the last row of the range before
        of = of.withColumn("_own", F.when(F.col("_end").isNotNull() & starts(F.col("_end"), F.col("_head")), 1).otherwise(0))
        of = of.withColumn("_offset", F.coalesce(F.sum(F.col("_runs") + F.col("_own")).over(r.all_before), F.lit(0)) + F.col("_own"))
        rows = r.with_carry(rows, of, "_offset").withColumn(name, F.col(name) + F.col("_offset"))
    return r.done(rows, "_now", "_before", "_new", "_offset")


def islands(rows: DataFrame, group: list[str], order: list[str], value: str, gap: float, name: str = "island", most: int = ROWS) -> DataFrame:
    """Consecutive rows of a group whose values are no more than ``gap`` apart share a number from 1."""
    return numbered(rows, group, order, [value], lambda before, now: now[value] - before[value] > gap, name, most=most)


def ends_before_next(starts: DataFrame, doc: str, start: str, last: str, name: str = "end", most: int = ROWS) -> DataFrame:
    """Ranges from starts: each ends before the next start of its document, the last one at ``last``."""
    r = Ranges(starts, [doc], [start], most=most)
    rows = r.rows.withColumn("_next", F.lead(start).over(r.here))
    if r.split:
        of = r.summed_up(rows, _head=F.min(start)).withColumn("_following", F.lead("_head").over(r.in_order))
        rows = r.with_carry(rows, of, "_following").withColumn("_next", F.coalesce("_next", "_following"))
    return r.done(rows.withColumn(name, F.coalesce(F.col("_next") - 1, F.col(last))), "_next", "_following")


def differences(rows: DataFrame, group: list[str], order: list[str], value: str, name: str, most: int = ROWS) -> DataFrame:
    """The value less the one before it in its group's order; null for the first."""
    r = Ranges(rows, group, order, most=most)
    rows = r.rows.withColumn("_before", F.lag(value).over(r.here)).withColumn("_first", F.row_number().over(r.here) == 1)
    if r.split:
        of = r.summed_up(rows, _tail=F.max_by(F.struct(value), r.place)).withColumn("_end", F.lag("_tail").over(r.in_order))
        rows = r.with_carry(rows, of, "_end").withColumn("_before", F.when(F.col("_first"), F.col(f"_end.{value}")).otherwise(F.col("_before")))
    return r.done(rows.withColumn(name, F.col(value) - F.col("_before")), "_before", "_first", "_end")


def coalesced(edits: DataFrame, stream: str, order: list[str], signature: list[str], old: str, new: str, most: int = ROWS) -> DataFrame:
    """Runs of edits with one signature as a single edit: the first old value, the last new one, and how many."""

    def differs(before: Column, now: Column) -> Column:
        return ~before.eqNullSafe(now)

    runs = numbered(edits, [stream], order, signature, differs, "run", most=most)
    at = F.struct(*order)
    return runs.groupBy(stream, "run", *signature).agg(F.min_by(old, at).alias(old), F.max_by(new, at).alias(new), F.count("*").alias("edits"))


def undone(edits: DataFrame, stream: str, order: list[str], is_undo: str, most: int = ROWS) -> DataFrame:
    """Edits that are left after each undo took back the last edit before it that was still there.

    An undo at depth d closes the edit at that depth: an edit is taken back if the depth falls below its own at any later point. An undo of nothing does
    nothing: depth counts from the lowest point so far. A range hands on how deep it ends and how deep it reaches, forwards; and how deep it reaches, backwards.
    """
    r = Ranges(edits, [stream], order, most=most)
    zero = F.lit(0).cast("long")
    rows = r.rows.withColumn("_raw", F.sum(F.when(F.col(is_undo), -1).otherwise(1)).over(r.so_far))
    rows = rows.withColumn("_low", F.min("_raw").over(r.so_far))
    if r.split:
        of = r.summed_up(rows, _height=F.sum(F.when(F.col(is_undo), -1).otherwise(1)), _reach=F.min("_raw"))
        of = of.withColumn("_base", F.coalesce(F.sum("_height").over(r.all_before), zero))
        of = of.withColumn("_reach", F.col("_base") + F.col("_reach")).withColumn("_deepest", F.coalesce(F.min("_reach").over(r.all_before), zero))
        rows = r.with_carry(rows, of, "_base", "_deepest").withColumn("_raw", F.col("_raw") + F.col("_base")).withColumn("_low", F.least(F.col("_low") + F.col("_base"), F.col("_deepest")))
    rows = rows.withColumn("_depth", F.col("_raw") - F.least(zero, F.col("_low")))
    rows = rows.withColumn("_later", F.min("_depth").over(r.to_come))
    if r.split:
        of = r.summed_up(rows, _least=F.min("_depth")).withColumn("_after", F.min("_least").over(r.all_after))
        rows = r.with_carry(rows, of, "_after").withColumn("_later", F.least("_later", "_after"))
    left = rows.where(~F.col(is_undo) & (F.coalesce("_later", F.col("_depth")) >= F.col("_depth")))
    return r.done(left, "_raw", "_low", "_base", "_deepest", "_depth", "_later", "_after")
