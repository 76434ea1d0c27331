"""The ranking function: defaults, best of all parts, failures; and the searches' own selections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import ranking as K
from paperloom.operators import search as S


def test_defaults_order_and_parts(spark):
    index = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id int, text string")

    def rank(query, rows):
        return [{"file": r["text"], "score": (r["id"] % 10) / 10} if r["id"] != 9 else {"title": "only"} for r in rows if query == "q" or r["id"] < 3]

    got = {}
    for r in K.ranked(index, ["q", "few", "none"], lambda q, rows: rank(q, rows) if q != "none" else None, 5, parts=4, chunk=3).orderBy("place").collect():
        got.setdefault(r.query, []).append((r.file, r.score, r.slide_num, r.title))
    assert got == {"q": [(f"t{i}", 0.9, 1, "") for i in (19, 29, 39, 49)] + [("t18", 0.8, 1, "")], "few": [("t2", 0.2, 1, ""), ("t1", 0.1, 1, ""), ("t0", 0.0, 1, "")]}


def test_the_index_stays_where_it_lies(spark):
    """Only the best k of each partition and query move, so that no task's input grows with the index."""
    index = spark.range(0, 4000, 1, 8)
    ranked = K.ranked(index, ["a", "b"], lambda q, rows: [{"score": float(r["id"])} for r in rows], 3, chunk=100)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(query" in plan
    assert sorted((r.query, r.score) for r in ranked.collect()) == [(q, float(s)) for q in "ab" for s in (3997, 3998, 3999)]


def test_a_failure_is_raised(spark):
    index = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(Exception, match="no such rank"):

        def rank(query, rows):
            raise RuntimeError("no such rank")

        K.ranked(index, ["q"], rank, 1).collect()


def test_partial_selection_is_the_sorted_one():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 6, (20, 90)).astype(float), np.array([rng.permutation(90) for _ in range(20)])
    order = np.lexsort((ids, -scores), axis=1)[:, :4]
    best, at = S._best(scores, ids, 4)
    assert (best == np.take_along_axis(scores, order, 1)).all() and (at == np.take_along_axis(ids, order, 1)).all()


def test_items_in_blocks(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, sorted({str(w) for w in rng.choice(words, 12)})) for i in range(60)] + [(99, [])]
    items = [(i, sorted({str(w) for w in rng.choice(words, 4)})) for i in range(20)] + [(50, ["nowhere"]), (51, [])]
    t, i = spark.createDataFrame(texts, "k long, w array<string>").repartition(3), spark.createDataFrame(items, "i long, w array<string>")
    want = {}
    for n, own in items:
        best = max(((len(set(own) & set(w)) / len(own), -k) for k, w in texts), default=(0, 0)) if own else (0, 0)
        if best[0]:
            want[n] = (-best[1], best[0])
    for block in (S.ITEM_BYTES, 40):
        assert {r.i: (r.k, r.score) for r in S.best_text_for(t, i, "k", "i", "w", block).collect()} == want


def test_tag_score_counts_the_description(spark):
    row = spark.createDataFrame([(1, ["png"], "deck.pptx", None, "a cat", "cat cat", "cat_1", "png"), (2, ["x"], "", "", "cat", "", "", "jpg")], "k int, tags array<string>, source string, title string, context string, d string, name string, f string")
    columns = {"tags": F.col("tags"), "source": F.col("source"), "title": F.col("title"), "context": F.col("context"), "description": F.col("d"), "name": F.col("name"), "format": F.col("f")}
    got = S.tag_search(row, ["CAT"], 5, "k", columns).collect()
    assert [(r.k, r.score) for r in got] == [(1, 3 + 1.5), (2, 1.0)]
    assert [r.k for r in S.tag_search(row, ["cat"], 5, "k", columns, ["JPG"]).collect()] == [2]
