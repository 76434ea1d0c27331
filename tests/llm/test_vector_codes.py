"""Vector codes: against plain rounds in Python integers, bounds that hold, odd rows."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = len(kept[0][1]) // parts
    part = lambda v, p: v[p * step : (p + 1) * step]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    books = [[part(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        at = [[nearest(v, p)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), x in zip(kept, at[p], strict=True) if x == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = [(i, label, "".join(f"{nearest(v, p)[1]:02x}" for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts))) for i, v, label in kept]
    return sorted(((i, code, min(error, V.LONGEST), min(sum(x[3] for x in coded if x[1] == label), V.LONGEST), digest) for i, label, code, error in coded), key=str)


def coded(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumn("code", F.lit("x"))
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in V.encode(df).collect()), key=str)


def test_plain_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 24).tolist(), int(rng.integers(0, 3)) if i % 9 else None) for i in range(150)]
    rows += [(500 + i, rows[7][1], 1) for i in range(60)]  # copies
    rows += [(1, rows[1][1], 2), (None, rows[3][1], 0), (-4, [0.0] * 24, 5)]  # repeated, null and negative ids
    rows += [(900, None, 1), (901, [None] * 24, 1), (902, [math.nan] * 24, 1), (903, [math.inf] + [0.0] * 23, 1)]
    assert coded(spark, rows) == plain(rows)


def test_wide_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 16) * 10.0 ** rng.integers(-3, 9)).tolist(), i % 2) for i in range(40)] + [(99, [1e30] * 16, 0)]
    assert coded(spark, rows) == plain(rows)


def test_few_rows_and_other_lengths(spark):
    assert coded(spark, []) == []
    one = [(3, [0.5] * 8, 1)]
    assert coded(spark, one) == plain(one)
    got = coded(spark, [(3, [0.5] * 8, 1), (4, [0.5] * 9, 1), (5, [], 1)])
    assert [(r[0], r[1]) for r in got] == [(3, "00" * 8), (4, None), (5, None)]
    assert coded(spark, [(1, [0.25] * 3, None)])[0][1:4] == ("00" * 8, 0, 0)  # filled with zeros
    assert coded(spark, [(None, [0.25] * 8, None)])[0][1] is None


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(6)
    points, centres = rng.integers(-2000, 2000, (400, 64)), rng.integers(-2000, 2000, (16, 64))
    vectors = centres[rng.integers(0, 16, 400)] + points // 20
    books = V.Codebooks(centres.reshape(16, 8, 8).transpose(1, 0, 2))
    lower, upper = books.bounds(vectors)
    exact = ((vectors.reshape(400, 8, 1, 8) - books.entries[None]) ** 2).sum(3)
    assert (lower <= exact).all() and (exact <= upper).all()
    code, distance, refined = books.nearest(vectors)
    assert (code == exact.argmin(2)).all() and (distance == exact.min(2)).all()
    assert refined < 0.3 * exact.size
