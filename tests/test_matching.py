"""Matching in tiers: the substring join against all pairs, every tier, odd texts."""

import random

from paperloom.operators import matching as M


def test_containing_is_all_pairs_that_contain(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab中é ") for _ in range(n))
    needles = [word(rng.randint(0, 8)) for _ in range(120)] + ["", None, "x" * 9, "..", "a.b"]
    hay = [word(rng.randint(0, 40)) for _ in range(80)] + [None, "", "xa.b" + "x" * 400, "a\nb\nab" * 30]
    n, h = spark.createDataFrame([(x,) for x in needles], "n string"), spark.createDataFrame([(x,) for x in hay], "h string")
    got = [tuple(r) for r in M.containing(n, "n", h, "h").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in needles if a for b in hay if b is not None and a in b}
    assert "CartesianProduct" not in M.containing(n, "n", h, "h")._jdf.queryExecution().toString()


def test_titles_in_four_tiers(spark):
    stems = [(1, "01_Cover"), (2, "02_Market size"), (3, "03_team"), (4, "Team-photo"), (5, "03_team"), (6, "p4_end"), (7, "第7页 end")]
    titles = [("a", "01_Cover"), ("b", "02 market  SIZE"), ("c", "Slide 4: end"), ("d", "photo"), ("e", "team"), ("f", "03_team"), ("g", "7"), ("h", ""), ("i", None), ("j", "1234"), ("k", "Cover")]
    got = M.match_titles(spark.createDataFrame(titles, "k string, title string"), "title", "k", spark.createDataFrame(stems, "id long, stem string"), "stem", "id")
    assert {r.k: (r.id, r.tier) for r in got.collect()} == {
        "a": (1, 1), "b": (2, 2), "c": (6, 3), "d": (4, 4), "e": (None, 0), "f": (3, 1), "g": (7, 3), "h": (None, 0), "i": (None, 0), "j": (None, 0), "k": (1, 4),
    }


def test_replacements_in_three_tiers_and_map_order(spark):
    mapping = [(1, "price list", "PL"), (2, "price", "P"), (3, "old price list 5", "X"), (4, "（note）", "N1"), (5, "(note)", "N2"), (6, "abcd", "no"), (7, "price", "P2")]
    texts = [("a", " price "), ("b", "(note) "), ("c", "（note）"), ("d", "the old price list 5 and price list"), ("e", "xabcdx"), ("f", "price　list"), ("g", " "), ("h", None), ("i", "a price, a price")]
    got = M.match_replacements(spark.createDataFrame(texts, "k string, t string"), "t", "k", spark.createDataFrame(mapping, "at long, old string, new string"), "old", "new", "at")
    assert {r.k: (r.replaced, r.tier) for r in got.collect()} == {
        "a": ("P2", 1), "b": ("N2", 1), "c": ("N1", 1), "d": ("the old PL 5 and PL", 3), "e": (None, 0), "f": ("PL", 2), "g": (None, 0), "h": (None, 0), "i": ("a P2, a P2", 3),
    }
