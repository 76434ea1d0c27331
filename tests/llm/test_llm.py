"""The operators of the llm subpackage against brute-force versions, with odd rows in every column."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from paperloom.llm import _common, bpe_codec, decontaminate, license_scan, lm_scores, ngram_jaccard, quality_rules, queries, sharding, token_counts, token_files, toxicity  # noqa: E402

BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood where nobody ever goes at night"
ROWS = [
    (1, BASE),
    (2, BASE),
    (2, BASE),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one"),
    (7, "one two"),
    (None, "a row without an id that has some words"),
    (8, "Ünïcödé <|endoftext|> don't   STOP here 12345 日本語 é"),
    (9, "x " * 30000),
    (10, BASE.upper()),
    (11, ("word%d " * 1) % 7 + BASE),
    (12, " " * 5000 + "a" + "\n" * 3000),
    (13, "y" * 20000),
    # ids that differ in their sign, width or nullness only, and ids that stand on several texts
    (0, "same text here"),
    (None, "same text here"),
    (-1, "x y"),
    ((1 << 63) - 1, "x y"),
    (-(1 << 63), "x y z"),
    (7, "another text under an id that is taken, with words of its own"),
    (3, "a third <|startoftext|>text l'\u00e9t\u00e9, it's 3\u00b2 \u0130 e\u0301"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "word", 0.5, "h") for i, t in ROWS], "doc_id long, text string, word string, score double, h string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, word string, score double, h string")


def words(t):
    return (t or "").encode().lower().split()


def windows(t, k):
    w = words(t)
    return set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def test_decontamination_matches_brute_force(spark, docs, nothing):
    items = [(1, BASE), (2, "one two"), (3, None), (4, ""), (5, " ".join(BASE.split()[:12])), (6, " ".join(BASE.split()[:10]) + " but not this at all here"), (5, " ".join(BASE.split()[:12])), (None, BASE), (9, BASE)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in ROWS:
        for i, x in items:
            s = windows(x, 5)
            if s and 100 * len(s & windows(t, 5)) >= 80 * len(s):
                want[d, i] += 1
    for block in (16 << 20, 400, 8):  # whole, in blocks, and with every item too long for a block
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, table, block_bytes=block).collect())
        assert got == want
    kept = decontaminate.drop_contaminated(docs, table, block_bytes=400)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, t in ROWS if not any(windows(x, 5) and 100 * len(windows(x, 5) & windows(t, 5)) >= 80 * len(windows(x, 5)) for _, x in items))
    assert decontaminate.contained_items(nothing, table).count() == 0
    assert decontaminate.contained_items(docs, table.where("false")).count() == 0


def test_sketch_search_has_no_false_negatives():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(5, 60)))).encode()) for i in range(60)]
    sketches, cache = decontaminate.Sketches(items), _common.WordHashes()
    for _ in range(40):
        parts = [items[int(rng.integers(60))][1].split() for _ in range(3)]
        text = b" ".join(b" ".join(p[int(rng.integers(0, 4)) :]) for p in parts)
        got = {i for i, _ in sketches.find(text, _common.shingle_hashes(_common.word_hashes(text.split(), cache), 5))}
        own = windows(text.decode(), 5)
        assert got == {k for k, (_, x) in enumerate(items) if 100 * len(windows(x.decode(), 5) & own) >= 80 * len(windows(x.decode(), 5))}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("hot", [1 << 22, 3, 0])
def test_token_counts(docs, nothing, tokenizer, hot):
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, P.path("word_bpe_49k.json"), 2048, hot_words=hot).collect())
    want = Counter()
    for d, t in ROWS:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_counts.token_counts(nothing, P.path("word_bpe_49k.json"), 2048).count() == 0


def jaccard_truth(rows, percent=90):
    sets = [windows(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def test_jaccard_join(spark, docs, nothing):
    assert Counter(map(tuple, ngram_jaccard.jaccard_components(docs).collect())) == jaccard_truth(ROWS)
    assert ngram_jaccard.jaccard_components(nothing).count() == 0
    stays = ngram_jaccard.one_of_each_group(docs)
    assert stays.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in stays.collect()) == Counter(one_of_each(ROWS))
    assert ngram_jaccard.one_of_each_group(nothing).count() == 0
    clash = docs.select("doc_id", "text", F.lit("x").alias("d1"), F.lit("y").alias("n"), F.lit("z").alias("place"), F.lit(1).alias("copy"), F.lit(2).alias("k1"))
    stays = ngram_jaccard.one_of_each_group(clash)
    assert stays.columns == clash.columns and stays.count() == len(one_of_each(ROWS))


def one_of_each(rows, k=3, percent=90):
    """The rows that stay: of each component the lowest id, of equal rows one, and all without words."""
    sets = [windows(t, k) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    out = [r for r, s in zip(rows, sets, strict=True) if not s]
    for c in {x for x, s in zip(root, sets, strict=True) if s}:
        out.append(min((r for r, x in zip(rows, root, strict=True) if x == c), key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def test_jaccard_join_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows, base = [], [f"b{i}" for i in range(120)]
    for i in range(160):  # around the threshold, so that many rows link to some but not to others
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            w[k] = f"e{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    for i in range(200, 240):  # a common passage in different texts
        rows.append((i, " ".join(base[:60]) + " " + " ".join(f"u{i}x{k}" for k in range(int(rng.integers(1, 60))))))
    for heavy in (1 << 20, 0):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(map(tuple, ngram_jaccard.jaccard_components(table, heavy=heavy).collect())) == jaccard_truth(rows)


def test_jaccard_join_of_a_large_cell(spark, monkeypatch):
    """A block whose rows share a long passage: hubs that link to few, so that slabs of the product are used."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base, *(f"u{i}x{k}" for k in range(int(rng.integers(3, 9))))])) for i in range(150)]
    rows += [(200 + i, " ".join([*base, "c1", "c2", "c3", "c4", "c5", *(f"v{i}x{k}" for k in range(int(rng.integers(0, 5))))])) for i in range(60)]
    monkeypatch.setattr(ngram_jaccard, "SMALL", 4)
    monkeypatch.setattr(ngram_jaccard.cell_links, "__defaults__", (16,))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for heavy in (1 << 20, 0):
        assert Counter(map(tuple, ngram_jaccard.jaccard_components(table, heavy=heavy).collect())) == jaccard_truth(rows)
    got = ngram_jaccard.one_of_each_group(table, k=5, percent=80).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(one_of_each(rows, 5, 80))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(50, 51), (51, 50), (60, 60)]
    got = {r.node: r.root for r in _common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 50: 50, 51: 50}


def toxic_rows(n=400):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        w = [f"{a}{b}" for a, b in zip(rng.choice(["an", "be", "co", "du"], 40), rng.integers(0, 50, 40))]
        bad = i % 4 == 0
        if bad:
            for k in rng.choice(40, 3, replace=False):
                w[k] = f"foulo{rng.integers(0, 60)}"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_generalises_and_handles_odd_rows(spark, docs, nothing):
    rows, labels = toxic_rows()
    table, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, lab)
    got = toxicity.score_documents(table, model).collect()
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert Counter(r.doc_id for r in toxicity.score_documents(docs, model).collect()) == Counter(d for d, _ in ROWS)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score_documents(nothing, toxicity.fit(nothing, lab)).count() == 0
    assert {r.predicted for r in toxicity.score_documents(table, toxicity.fit(table, lab.where("toxic = 0"))).collect()} == {0}


def test_factorization_machine_learns_a_pair():
    # neither term alone is toxic, both together are: beyond additive weights
    one, two, rest = 11, 22, list(range(100, 140))
    rng = np.random.default_rng(2)
    rows, y = [], []
    for k in range(600):
        have = [t for t, on in ((one, k % 2), (two, k // 2 % 2)) if on]
        n = np.array(sorted(have + rng.choice(rest, 5, replace=False).tolist()), np.int64)
        rows.append((n, np.full(len(n), 1.0, np.float32)))
        y.append(float(len(have) == 2))
    model = toxicity.train(rows, np.array(y), np.ones(len(y)), epochs=40)
    right = sum((model.score(*r) >= 0.5) == (t == 1) for r, t in zip(rows, y, strict=True))
    assert right >= 0.97 * len(rows)


def hidden_pair(seed, n=1500, weak=1400):
    """Terms 11 and 22 decide the label together only; each of 1,400 others leans a little to one label."""
    rng, rows, y = np.random.default_rng(seed), [], []
    lean = np.random.default_rng(9).normal(0, 0.35, weak)
    for k in range(n):
        one, two = k % 2, k // 2 % 2
        toxic = one and two
        have = 2000 + np.flatnonzero(rng.random(weak) < 1 / (1 + np.exp(3.2 - lean * (1 if toxic else -1))))
        have = np.array(sorted([*have.tolist(), *[11] * one, *[22] * two]))
        rows.append((have, np.full(len(have), 10 / np.sqrt(len(have)), np.float32)))
        y.append(float(toxic))
    return rows, np.array(y)


def test_factorization_machine_learns_a_pair_among_many_terms():
    rows, y = hidden_pair(1)
    model = toxicity.train(rows, y, np.ones(len(y)))
    fresh, truth = hidden_pair(2)
    assert np.mean([(model.score(*r) >= 0.5) == (t == 1) for r, t in zip(fresh, truth, strict=True)]) >= 0.97
    assert model.factors[11] @ model.factors[22] > 0.5


def test_toxicity_scores_match_the_formula(spark, docs):
    rng = np.random.default_rng(3)
    size = 1 << toxicity.BITS
    model = toxicity.FactorizationMachine(-0.3, rng.normal(0, 0.5, size).astype(np.float32), rng.normal(0, 0.3, (size, toxicity.FACTORS)).astype(np.float32))
    want = Counter()
    for d, t in ROWS:
        found = Counter(toxicity.WORD.findall((t or "").lower()))
        share = Counter()
        for w, n in found.items():
            for key in [w, *(f"{k}:{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k)]:
                share[toxicity.xxhash.xxh3_64_intdigest(key) % size] += n / sum(found.values())
        x = {i: 10 * math.sqrt(v) for i, v in share.items()}
        z = model.bias + sum(float(model.weights[i]) * v for i, v in x.items())
        z += sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for i in x for j in x if i < j)
        p = 1 / (1 + math.exp(-max(min(z, 60), -60)))
        want[d, round(p, 3), int(p >= 0.5)] += 1
    assert Counter((r.doc_id, round(r.score, 3), r.predicted) for r in toxicity.score_documents(docs, model).collect()) == want
    # an id on several texts, and labels that repeat: one row of each id teaches
    lab = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (7, 1, 0), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    picked = toxicity.labelled_sample(docs, lab, "toxic", 10)
    assert sorted((r.doc_id, r.label) for r in toxicity.one_row_each(docs, picked, "text").collect()) == [(3, 1), (7, 0)]


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, nothing, encoding):
    got = Counter(tuple(r) for r in bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    want = Counter()
    for d, t in ROWS:
        ids = encoding.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe_codec.encode_decode(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    ids = bpe_codec.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe_codec.decode_documents(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert Counter((r.doc_id, bytes(r.data)) for r in back.collect()) == Counter((d, (t or "").encode()) for d, t in ROWS)


def test_bpe_cuts_are_safe(encoding):
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", " ", " ", "a", "word", "'s", "12", "é", "!", "日本", "_", "\x1c"]
    for _ in range(150):
        text = "".join(rng.choice(parts, 400).tolist())
        assert "".join(p for p, _ in bpe_codec.pieces(text * 6, 50)) == text * 6
        assert bpe_codec.encode(encoding, text * 6, 50) == encoding.encode_ordinary(text * 6)
    for text in (" " * 3000 + "b", "a" + "\n" * 4000, "a" + " " * 2500 + "\n" + "b c"):
        assert bpe_codec.encode(encoding, text) == encoding.encode_ordinary(text)
    long_ = "x" + " " * 2_000_000 + "y"  # over what the library can take at once
    assert encoding.decode(bpe_codec.encode(encoding, long_)) == long_


def test_token_files(spark, docs, nothing, tokenizer):
    got = token_files.write_and_read(docs, P.path("word_bpe_49k.json"), 1).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    at = 0
    for r, (d, t) in zip(sorted(got, key=lambda r: r.start), sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(r) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.write_and_read(nothing, P.path("word_bpe_49k.json"), 1).count() == 0


def quality_truth(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    chars = sum(c not in " \t\n\r\x0b\x0c" for c in t or "")
    return len(w), chars, sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(mark)


def test_quality_counts_and_trees(spark, docs, nothing):
    rows = [(100 + i, f"{BASE} and more {i}\nline\nline\n" * (1 + i % 3) + "#*|" * (i % 5)) for i in range(20)]
    table = spark.createDataFrame([(i, t, "w", 0.1, "h") for i, t in rows], docs.schema).union(docs)
    lab = spark.createDataFrame([(100 + i, int(i % 5 < 2), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(table, quality_rules.fit(table, lab)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *quality_truth(t)) for d, t in rows + ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed)
    assert quality_rules.judge(nothing, quality_rules.fit(nothing, lab)).count() == 0


def descend(trees, x):
    """One document through every tree, a node at a time."""
    z = trees.bias
    for node in trees.roots.tolist():
        while trees.left[node] != node:
            node = int(trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
        z += trees.value[node]
    return 1 / (1 + math.exp(-z))


def test_quality_verdicts_on_rows_that_were_not_fitted(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_rules.fit(docs, lab, folds=5)
    truth = {r.doc_id: r.quality for r in lab.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    right = Counter()
    for r in quality_rules.judge(docs, trees).collect():
        p = descend(trees, quality_rules.all_statistics(pa.array([(texts[r.doc_id] or '').encode()], pa.binary()))[0][1])
        assert abs(r.score - p) < 1e-9 and r.kept == (not r.base_failed and p >= 0.5)
        if truth.get(r.doc_id) is not None and not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            right[truth[r.doc_id], r.kept == bool(truth[r.doc_id])] += 1
    assert right[1, True] >= 0.97 * (right[1, True] + right[1, False]) > 20 and right[0, True] >= 0.9 * (right[0, True] + right[0, False])


def test_trees_are_monotonic():
    rng = np.random.default_rng(6)
    x = rng.random((1500, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2) ^ (rng.random(1500) < 0.05)).astype(float)
    trees = quality_rules.train(x, y, np.ones(1500), [-1, 0, 0])
    grid = np.repeat(rng.random((50, 1, 3)), 60, 1)
    grid[:, :, 0] = np.linspace(0, 1, 60)
    p = trees.score(grid.reshape(-1, 3)).reshape(50, 60)
    assert (np.diff(p, axis=1) <= 1e-12).all()
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.9


@pytest.mark.parametrize(("order", "hot", "arcs"), [(3, 1 << 20, 1 << 20), (2, 5, 4), (1, 5, 4)])
def test_lm_scores(docs, nothing, order, hot, arcs):
    got = lm_scores.lm_scores(docs, order=order, hot_tokens=hot, most_arcs=arcs).collect()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    c = Counter(x for d, t in ROWS if fold(d) != 1 for x in words(t) + [b" end"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in ROWS:
        w = words(t) + [b" end"]
        want[d, fold(d) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    truth = backoff_truth(ROWS, order, fold)
    assert Counter((r.doc_id, round(r.score, 3)) for r in got) == Counter((d, round(x, 3)) for (d, _), x in zip(ROWS, truth, strict=True))
    assert lm_scores.lm_scores(nothing).count() == 0


def backoff_truth(rows, order, fold, discount=0.75):
    """Scores by the recursive definition: discounted n-grams that occur twice, and what is left to the shorter context."""
    train = [words(t) + [b" end"] for d, t in rows if fold(d) != 1]
    c = Counter(x for w in train for x in w)
    scale = sum(c.values()) + 0.5 * (len(c) + 1)
    total, kinds, arcs = Counter(), Counter(), defaultdict(dict)
    for size in range(2, order + 1):
        for gram, n in Counter(g for w in train for g in zip(*[w[j:] for j in range(size)])).items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
            if n > 1:
                arcs[gram[:-1]][gram[-1]] = n
    weight = {}

    def p(context, x):
        if not context:
            return (c[x] + 0.5) / scale
        low = p(context[1:], x)
        if context not in arcs:
            return low
        if x in arcs[context]:
            return (arcs[context][x] - discount) / total[context] + discount * kinds[context] / total[context] * low
        if context not in weight:
            weight[context] = max(1 - sum(p(context, y) for y in arcs[context]), 1e-12) / max(1 - sum(p(context[1:], y) for y in arcs[context]), 1e-12)
        return weight[context] * low

    out = []
    for _, t in rows:
        w = words(t) + [b" end"]
        out.append(sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w)))
    for context in list(arcs)[:5]:  # a state's probabilities sum to what the tokens' own do
        assert abs(sum(p(context, x) for x in c) + 0.5 / scale * (weight.get(context) or 0) - 1) < 0.02 or len(c) < 5
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_have_every_ngram(spark, order):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(1, 60)) if i else 700) % 200)) for i in range(150)]
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    want = {d: x for (d, _), x in zip(rows, backoff_truth(rows, order, fold), strict=True)}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"hot_tokens": 20, "most_arcs": 40}, {"hot_tokens": 0, "most_arcs": 0}):  # what is sent changes no score
        got = {r.doc_id: r.score for r in lm_scores.lm_scores(table, order=order, **sizes).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def license_truth(text):
    """(paragraph, family, probability, overlap) by a plain evaluation of the model, of every paragraph, with a cue or without."""
    m, out = license_scan.model(), []
    for k, paragraph in enumerate(re.split(license_scan.BREAK, text or "")):
        grams = license_scan.grams_of(license_scan.tokens_of(paragraph))
        z = np.array(m["bias"])
        for g in grams:
            z = z + m["weights"].get(g, 0.0)
        p = np.exp((z - z.max()) / m["temperature"])
        family = m["families"][int(z.argmax())]
        if family != "unknown":
            overlap = max([len(grams & set(license_scan._pairs(t))) / len(license_scan._pairs(t)) for t in license_scan.templates(family)], default=0)
            out.append((k, family, round(float(1 / p.sum()), 6), round(overlap, 6)))
    return out


PROBES = {
    "distributed under GPLv3": "gpl",
    "distributed under the terms of the GNU GPL v3.": "gpl",
    "Dual: MIT OR Apache-2.0": "apache",
    "Lizenziert unter CC BY 4.0": "cc-by",
    "License: MIT": "mit",
    "CC BY-SA 4.0": "cc-by-sa",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "gpl",
}


def test_license_scan(spark, docs, nothing):
    assert license_scan.model()["held_out_accuracy"] > 0.95
    m = license_scan.model()
    assert m["families"][int(np.argmax(m["bias"]))] == "unknown" and all(map(license_scan.has_cue, m["weights"]))
    texts = [f"Some words here.\n{t}\n\nOther words" for family in license_scan.NAMES for t in license_scan.templates(family)]
    texts += [*PROBES, *license_scan.NEAR_MISSES, BASE, "no cue\n\n at all.\nmit\n", "x" * 50_000 + " all rights reserved", "\n".join(["Licensed under CC BY 4.0."] * 3), None, ""]
    table = spark.createDataFrame([(None if i % 7 == 0 else -i, t, "w", 0.0, "h") for i, t in enumerate(texts)] + [(-1, texts[1], "w", 0.0, "h")], docs.schema)
    want = Counter((None if i % 7 == 0 else -i, *r) for i, t in enumerate(texts) for r in license_truth(t)) + Counter((-1, *r) for r in license_truth(texts[1]))
    got = license_scan.scan(table).collect()
    assert Counter((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.template_overlap, 6)) for r in got) == want
    assert all(r.confirmed == (r.template_overlap >= 0.5) for r in got)
    for text, family in PROBES.items():
        (found,) = license_truth(text)
        assert found[:2] == (0, family) and found[3] >= 0.5
    named = sum(any(r[1] == family for r in license_truth(t)) for family in license_scan.NAMES for t in license_scan.templates(family))
    assert named >= 0.95 * sum(len(license_scan.templates(f)) for f in license_scan.NAMES)
    assert sum(bool(license_truth(t)) for t in license_scan.NEAR_MISSES) <= 3
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(nothing).count() == 0


def test_sharding(spark, docs, nothing):
    rng = np.random.default_rng(8)
    rows = [(i, "z" * int(rng.integers(0, 300)) if i % 3 else "a hot text that a third of all rows have") for i in range(3000)]
    table = spark.createDataFrame([(i, t, "w", 0.0, "h") for i, t in rows], docs.schema).repartition(4)
    got = sharding.shard(table, shards=7).collect()
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += len(r.text) + 16
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 7 + 330
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    shards_of = defaultdict(set)
    for r in got:
        shards_of[r.text].add(r.shard)
    share = sum(size.values()) / 7
    weight = Counter()
    for _, t in rows:
        weight[t] += len(t) + 16
    assert all(len(s) == 1 for t, s in shards_of.items() if weight[t] <= share) and max(weight.values()) > share
    few = sharding.shard(docs)
    assert few.columns == [*docs.columns, "shard", "slot"] and Counter((r.doc_id, r.text) for r in few.collect()) == Counter(ROWS)
    by = defaultdict(list)
    for r in few.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
    assert sharding.shard(nothing).count() == 0


def test_sharding_query(spark, tmp_path):
    """The query's columns against what they are defined as."""
    rows = [(i * (1 << 40) - (1 << 62) if i % 2 else i, None if i % 50 == 7 else "é" * (i % 90) + str(i % 300)) for i in range(2000)] + [(None, "x"), ((1 << 63) - 1, "y"), (-(1 << 63), "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_sharding(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode()), "bytes", None) for d, t in rows)
    total, slots = Counter(), defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(total) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 0.03 * sum(total.values()) / 40 + 2 * max(size(t) for _, t in rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) > 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # the same decisions, one by one
    tox = {r.doc_id for r in toxicity.score_documents(docs, toxicity.fit(docs, lab)).collect() if not r.predicted}
    left = docs.where(docs.doc_id.isin(list(tox)))
    kept = {r.doc_id for r in quality_rules.judge(left, quality_rules.fit(left, lab)).collect() if r.kept}
    rows = [(d, texts[d]) for d in kept]
    first = {d for d, _ in one_of_each(rows, 5, 80)}
    clean = {d for d in first if not any(100 * len(windows(x, 5) & windows(texts[d], 5)) >= 80 * len(windows(x, 5)) for x in items)}
    assert set(ids) == clean
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated texts, wide and repeated ids, clashing columns, and an empty table, through all stages."""
    import corpus_pipeline

    good = [(i, f"{BASE} number {i} " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(40)]
    rows = [*ROWS, *good, (good[3][0], good[4][1] + " again"), (None, good[5][1] + " tail"), ((1 << 62), good[6][1]), good[7]]
    table = spark.createDataFrame([(i, t, None, "s" if i else None, None, 1.0, "d", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, d1 string, copy int")
    items = spark.createDataFrame([(1, " ".join(good[9][1].split()[30:50])), (2, None), (None, ""), (1, "no such words stand anywhere at all")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, 1), (3, 0, None), (7, None, None)], "doc_id long, quality int, toxic int")
    for name, data in (("full", table), ("empty", table.where("false"))):
        data.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    lab = spark.read.parquet(f"{tmp_path}/full/labels.parquet")
    tox = toxicity.drop_toxic(docs, toxicity.fit(docs, lab))
    assert tox.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in quality_rules.drop_failed(tox, quality_rules.fit(tox, lab)).collect()]
    held = windows(items.first().text, 5)
    clean = [(d, t) for d, t in one_of_each(kept, 5, 80) if 100 * len(held & windows(t, 5)) < 80 * len(held)]
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert len(clean) > 20 and Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in clean)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    plain = lambda rows: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, got.collect())) == plain(want) and want
