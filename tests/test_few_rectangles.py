import random

from paperloom.operators import dedup


def test_pages_of_few_rectangles_need_no_cells(spark, monkeypatch):
    """The same pairs with and without a grid, which has a row for each cell of a rectangle."""
    rng = random.Random(4)
    rows = [(rng.randrange(6), k, float(rng.randrange(20)), float(rng.randrange(20)), float(rng.randrange(1, 90)), float(rng.randrange(1, 90))) for k in range(120)]
    r = spark.createDataFrame(rows, "page int, k int, x double, y double, w double, h double")
    held = {}
    for few in (0, 20, 64):
        monkeypatch.setattr(dedup, "FEW", few)
        held[few] = sorted(tuple(x) for x in dedup.contained_rectangles(r, "page", "k", cell=8).collect())
    assert held[0] == held[20] == held[64] and len(held[0]) > 0
