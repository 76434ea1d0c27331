"""License scans: licences that were never seen, bare names, what a cue is."""

from paperloom.llm import license_scan as L

UNSEEN = ["Licensed under the Eclipse Public License 2.0", "released under the zlib license", "GNU Free Documentation License", "distributed under the EUPL", "Published under the Foo Bar License, version 7", "license fees are due in may", "und er kam mit der Lizenz", "the of and to in a is that"]
SEEN = {"Released under MIT": "mit", "The code is under the MIT terms, see MIT.": "mit", "dual: Apache License 2.0 or commercial": "apache", "GPLv3": "gpl"}


def test_unseen_licences_are_unknown(spark):
    rows = [(i, t) for i, t in enumerate([*UNSEEN, *SEEN])]
    got = {r.doc_id: (r.family, r.verdict, r.confirmed) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {len(UNSEEN) + n: (family, family, True) for n, family in enumerate(SEEN.values())}


def test_names_that_were_held_out_are_rejected():
    held = [n for k, n in enumerate(L.OTHER_NAMES) if k % 4 == 3]
    m = L.model()

    def family(text):
        z = [sum(x) for x in zip(m["bias"], *(m["weights"][g] for g in L.grams_of(L.tokens_of(text)) if g in m["weights"]), strict=True)]
        return m["families"][z.index(max(z))]

    texts = [p.format(n) for n in held for p in L.PHRASES]
    assert sum(family(t) == L.UNKNOWN for t in texts) >= 0.95 * len(texts)
    # without a cue a text has no n-gram that raises a family, so it can't be one
    plain = [t for t in [*texts, *L.NEAR_MISSES] if not L.has_cue(t)]
    assert len(plain) > 100 and all(family(t) == L.UNKNOWN for t in plain)
    assert all(max(v[:-1]) <= v[-1] or L.has_cue(g) for g, v in m["weights"].items())


def test_the_pattern_of_cues():
    import re

    p = L.cue_pattern(["ab", "abc", "x y", "x", "q.1"])
    assert [bool(re.search(p, t)) for t in ("ab", "abd", "(abc)", "x, y", "xy", "q.1.", "qx1", "d-ab", "")] == [True, False, True, True, False, True, False, False, False]
