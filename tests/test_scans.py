"""Segmented scans: a key cut into ranges gives what one window gives."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import scans as S


def events(one_key: bool, n: int = 400):
    rng = random.Random(1)
    keys = ["k"] if one_key else ["k", "k", "k", "l", None]
    rows = [(rng.choice(keys), i, rng.choice([1, 1, 2, 30, 400]), rng.choice("aab"), rng.random() < 0.4) for i in range(n)]
    at, out = 0, []
    for k, i, step, kind, undo in rows:
        at += step
        out.append((k, i, at, kind if i % 7 else None, undo))
    return out


@pytest.fixture(params=[True, False], ids=["one key", "keys and nulls"])
def e(spark, request):
    return spark.createDataFrame(events(request.param), "k string, i long, s long, kind string, undo boolean").repartition(5)


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (a, b))
    assert a == b and len(a) > 0


SMALL, WHOLE = 23, 1 << 20


def test_ranges_split_a_key(e):
    r = S.Ranges(e, ["k"], ["i"], most=SMALL)
    assert r.split
    sizes = [x[0] for x in r.rows.groupBy("_scan_key", "_scan_range").count().select("count").collect()]
    assert max(sizes) <= 2 * SMALL and len(sizes) >= 400 / 2 / SMALL
    assert not S.Ranges(e, ["k"], ["i"], most=WHOLE).split


@pytest.mark.parametrize("order", [["i"], ["s", "i"]])
def test_islands_and_differences(e, order):
    same(*(S.islands(e, ["k"], order, "s", 25, most=m).select("k", "i", "island") for m in (SMALL, WHOLE)))
    same(*(S.differences(e, ["k"], order, "s", "d", most=m).select("k", "i", "d") for m in (SMALL, WHOLE)))


def test_coalesced_edits(e):
    named = e.withColumn("old", F.col("i")).withColumn("new", F.col("i"))
    split, whole = (S.coalesced(named, "k", ["i"], ["kind"], "old", "new", most=m) for m in (SMALL, WHOLE))
    same(split, whole)
    expected, before = [], None
    for k, i, _, kind, _ in events(True):
        if before != (k, kind):
            expected.append([k, len(expected) + 1, kind, i, i, 0])
            before = (k, kind)
        expected[-1][4:] = [i, expected[-1][5] + 1]
    if e.where("k is null or k != 'k'").isEmpty():
        assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, expected), key=str)


def test_undone_edits(e):
    split, whole = (S.undone(e, "k", ["i"], "undo", most=m).select("k", "i") for m in (SMALL, WHOLE))
    same(split, whole)
    stacks = {}
    for r in sorted(e.collect(), key=lambda r: r.i):
        stack = stacks.setdefault(r.k, [])
        if not r.undo:
            stack.append(r.i)
        elif stack:
            stack.pop()
    assert sorted(map(tuple, split.collect()), key=str) == sorted(((k, i) for k, x in stacks.items() for i in x), key=str)


def test_ends_before_next(e):
    rows = e.withColumn("last", F.lit(10**6).cast("long"))
    same(*(S.ends_before_next(rows, "k", "i", "last", most=m).select("k", "i", "end") for m in (SMALL, WHOLE)))


def test_ties_in_the_cut_column_and_no_rows(spark):
    tied = spark.createDataFrame([("k", i, 5, "a", False) for i in range(90)], "k string, i long, s long, kind string, undo boolean")
    same(*(S.islands(tied, ["k"], ["s", "i"], "s", 1, most=m).select("k", "i", "island") for m in (SMALL, WHOLE)))
    assert S.islands(tied.where("false"), ["k"], ["s", "i"], "s", 1, most=SMALL).count() == 0
