"""The similarity join: equal to all pairs at every threshold, few visits at high ones, copies in order."""

import numpy as np
import pytest

from paperloom.operators import dedup as G


def table(spark, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<float>").repartition(4)


def clustered(seed=1, n=300, width=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, width))
    v = centres[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("threshold", [-2.0, 0.0, 0.45, 0.95, 0.995])
@pytest.mark.parametrize("scale", [False, True])
def test_all_pairs_at_every_threshold(spark, threshold, scale):
    m = clustered(n=120)
    if scale:
        m = m * np.random.default_rng(2).uniform(0, 2, (len(m), 1)).astype(np.float32)
    got = [tuple(r) for r in G.similar_pairs(table(spark, m), threshold, block=17).collect()]
    x = m.astype(float) @ m.astype(float).T
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if x[i, j] > threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_few_cells_are_visited_at_a_high_threshold(spark):
    m = clustered(n=600).astype(float)
    rows = table(spark, m).selectExpr("vec_id as k", "cast(embedding as array<double>) as v")
    cells, sizes = G.cells_of(rows, 16, 24)
    along, across, home = cells.placed(m)
    assert sum(sizes.values()) == 600
    assert cells.reached(along, across, 0.95).sum() < 0.25 * cells.reached(along, across, -9.0).sum()
    assert "CartesianProduct" not in G.similar_pairs(table(spark, m), 0.95)._jdf.queryExecution().toString()


def test_greedy_with_copies(spark):
    m = clustered(n=80)
    m = np.concatenate([m, m[5:6].repeat(90, 0), m[:3], m[:40] * 0.2])
    x = m.astype(np.float32).astype(float)
    x = x @ x.T
    kept = []
    for i in range(len(m)):
        if not any(x[i, k] > 0.9 for k in kept):
            kept.append(i)
    got = {r.vec_id: r.kept for r in G.greedy_similar(table(spark, m), 0.9).collect()}
    assert len(got) == len(m) and sorted(k for k, v in got.items() if v) == kept


def test_odd_vectors(spark):
    rows = [(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0]), (None, [1.0, 0.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in G.similar_pairs(df, 0.5).collect()] == [(2, 3)]
    assert G.similar_pairs(df.where("false"), 0.5).count() == 0
