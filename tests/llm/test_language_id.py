"""Language identification: marginals against all label sequences, gradients, held-out accuracy, switched texts, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import language_id as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def all_sequences(e, transitions):
    """Marginals by the sum over every sequence of labels, and the log of the sum."""
    n, k = e.shape
    total, out = 0.0, np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n + 1):
        weight = np.exp(sum(transitions[a, b] for a, b in itertools.pairwise(ys)) + sum(e[t, y] for t, y in enumerate(ys[1:]))) / k
        total += weight
        out[np.arange(n), ys[1:]] += weight
    return out / total, np.log(total)


def test_marginals_are_those_of_all_sequences():
    rng = np.random.default_rng(1)
    e, transitions = rng.normal(0, 2, (3, 5, 3)), rng.normal(0, 1, (3, 3))
    got, _ = L.forward_backward(e, transitions)
    for i in range(3):
        assert np.allclose(got[i], all_sequences(e[i], transitions)[0])


def test_blocks_give_the_same_marginals_as_one_chain():
    rng = np.random.default_rng(2)
    counts, transitions = np.array([0, 3, 700, 1, 64, 0, 65, 128, 5]), rng.normal(0, 1, (4, 4))
    e = rng.normal(0, 3, (int(counts.sum()), 4)).astype(np.float32)
    got, low = L.chains(e, counts, transitions), 0
    for n in counts:
        if n:
            assert np.allclose(got[low : low + n], L.forward_backward(e[None, low : low + n].astype(float), transitions)[0][0])
        low += n
    assert L.chains(e[:0], np.array([0, 0]), transitions).shape == (0, 4)


def test_expected_transitions_are_the_slope_of_the_likelihood():
    rng = np.random.default_rng(3)
    e, transitions = rng.normal(0, 1, (4, 2)), rng.normal(0, 1, (2, 2))
    _, pairs = L.forward_backward(e[None], transitions)
    for a, b in itertools.product(range(2), repeat=2):
        moved = transitions.copy()
        moved[a, b] += 1e-6
        assert abs((all_sequences(e, moved)[1] - all_sequences(e, transitions)[1]) / 1e-6 - pairs[a, b]) < 1e-4


def test_features_of_a_word():
    number, value, count = L.features(["Abc", "", "42", "ab1c", "é"])
    assert count.tolist() == [2 * 3 + 1 + 4 + 3, 0, 0, 14, 6] and (value > 0).all()
    assert number[:14].tolist() == number[14:28].tolist()  # letters only, lower case
    assert L.features(["x" * 5000])[2].tolist() == [5001 + 5000 + 4 + 4 + 1]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, L.fit(docs)


def test_held_out_accuracy(spark, fitted):
    docs, model = fitted
    got = L.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    fold = [r for r in got if r.held_out and r.lang and r.text and any(map(str.isalpha, r.text))]
    right = sum(r.lang_pred == r.lang for r in fold)
    assert right >= 0.98 * len(fold), (right, len(fold))


def test_switched_text_is_cut_where_it_switches(spark, fitted):
    docs, model = fitted
    texts = {r.lang: r.text.split()[:40] for r in docs.where("lang in ('de', 'es') and length(text) > 600 and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    text = " ".join(texts["de"] + texts["es"])
    runs = L.label_words(spark.createDataFrame([(1, text, None)], SCHEMA), model).orderBy("first_word").collect()
    at = {x: r.lang for r in runs for x in range(r.first_word, r.first_word + r.n_words)}
    assert sum(r.n_words for r in runs) == 80
    assert sum(at[i] == ("de" if i < 40 else "es") for i in range(80)) >= 70


def test_odd_rows(spark, fitted):
    _, model = fitted
    long = "der die das und " * 60000
    rows = [(1, None, "de"), (2, "", "de"), (3, " \n\t", None), (4, "12 34 ... !", "en"), (None, "der die und nicht schön", None), (-7, "x", "en"), (6, long, "de"), (6, long, "de"), (7, "ß" * 300000, None), (8, "語" * 50, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("?")).withColumn("lang_pred", F.lit(1))
    got = [tuple(r) for r in L.predict(df, model).collect()]
    assert len(got) == len(rows)
    assert [r[2:] for r in got if r[0] in (1, 2, 3, 4)] == [("und", 0.0)] * 4
    assert [r[2] for r in got if r[0] in (6, None)] == ["de"] * 3
    assert all(r[3] > 0 for r in got if r[0] in (-7, 7, 8))


def test_nothing_learned(spark):
    rows = [(1, "a b c", None), (2, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r)[2:] for r in L.predict(df, L.fit(df)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(0, "a b c", "en"), (2, "d", None), (4, None, "fr")], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in L.predict(one, L.fit(one)).collect()} == {0: "en", 2: "en", 4: "und"}
    none = spark.createDataFrame([], SCHEMA)
    assert L.predict(none, L.fit(none)).count() == 0
