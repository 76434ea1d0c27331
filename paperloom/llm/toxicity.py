"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text: its words (runs of letters and digits of the lower-cased text) and, for each longer word,
its first 3, 4, 5 and 6 characters, so that forms of one stem share terms. A term's value is the square
root of its share of the text's words: each kind of term is then a unit vector at most, whatever the length.
Score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): the pairwise part learns that two
harmless terms together (an insult and a group's name) are not harmless, which additive weights can't.

The model is trained on the driver, by AdaGrad that touches a batch's terms only, on a bounded sample of labelled rows: at most
``SAMPLE`` ids of each class, taken in the order of a hash of their ids, each class weighted back to its
true share, and one row of each id. No term is left out for telling little by itself, only those that fewer than ``LEAST_DOCS`` sampled documents have. The sampled
documents' terms are hashed on the executors. The model (a table of 2^18 terms by 1 + FACTORS floats,
7 MB) is broadcast and scoring is one narrow pass over whole texts, whatever their length.

Labels, lang, source and doc_id are never inputs of a score. Null text: as empty. Empty text: no
terms, the score is the bias alone. No labelled rows of one class, or an empty table: all scores are that class's prior (0 if none is known).
Repeated rows: a row each; ids that stand on several texts teach by the text that sorts first. Labels that repeat a doc_id with both values: the higher counts.
Ties: a score of 0.5 is predicted 1. Extra columns: ignored by :func:`score_documents`, kept by :func:`drop_toxic`, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_LENGTH, CACHE_WORDS, fold_of, slices

BITS, FACTORS = 18, 6
PREFIXES = (3, 4, 5, 6)
SAMPLE = 3000
LEAST_DOCS = 3
EPOCHS = 12
#: Values are square roots of shares, mostly under 0.1; this brings them to the scale of the weights.
SCALE = 10.0
FOLDS = 5
WORD = re.compile(r"[^\W_]+")

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class WordTerms(dict):
    """word -> its term numbers: the word, then its prefixes."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        mask = (1 << BITS) - 1
        row = (xxhash.xxh3_64_intdigest(word) & mask, *(xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") & mask for n in PREFIXES if len(word) >= n))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS // 4:
                self.clear()
            self[word] = row
        return row


def terms(text: str | None, cache: WordTerms) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, values) of a whole text."""
    counts = Counter(WORD.findall((text or "").lower()))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    rows = [cache[w] for w in counts]
    share = np.fromiter(counts.values(), np.float64, len(counts))
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    numbers, at = np.unique(np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum())), return_inverse=True)
    share = np.bincount(at, np.repeat(share / share.sum(), lengths))
    return numbers.astype(np.int32), (SCALE * np.sqrt(share)).astype(np.float32)


class FactorizationMachine:
    """Bias, weights and factors by term number."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, numbers: np.ndarray, values: np.ndarray) -> float:
        z = self.bias
        if len(numbers):
            xv = self.factors[numbers] * values[:, None]
            total = xv.sum(0)
            z += float(self.weights[numbers] @ values) + 0.5 * float(total @ total - (xv * xv).sum())
        return 1.0 / (1.0 + np.exp(-min(max(z, -60.0), 60.0)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = 0.2, batch: int = 128, l1: float = 2e-3) -> FactorizationMachine:
    """AdaGrad on the weighted logistic loss; a batch changes the weights and factors of its own terms.

    The L1 penalty takes back to 0 what the gradients of many documents don't keep up.
    """
    size = 1 << BITS
    out_w, out_v = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    if not 0 < share < 1:
        return FactorizationMachine(40.0 if share else -40.0, out_w, out_v)
    counts = np.array([len(n) for n, _ in rows])
    flat, values = np.concatenate([n for n, _ in rows]), np.concatenate([v for _, v in rows])
    seen = np.bincount(flat, minlength=size)
    active = np.flatnonzero(seen >= min(LEAST_DOCS, 1 + len(rows) // 20))
    place = np.full(size, -1, np.int32)
    place[active] = np.arange(len(active))
    flat = place[flat]
    keep = flat >= 0
    counts = np.bincount(np.repeat(np.arange(len(rows)), counts)[keep], minlength=len(rows))
    flat, values, begins = flat[keep], values[keep], np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(active), np.float32), rng.normal(0, 0.02, (len(active), FACTORS)).astype(np.float32)
    b, gw, gv, gb = np.log(share / (1 - share)), np.full(len(active), 1e-3, np.float32), np.full((len(active), FACTORS), 1e-3, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            lengths = counts[part]
            at = np.repeat(begins[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            number, x = flat[at], values[at]
            if not len(number):
                continue
            owner, some = np.repeat(np.arange(len(part)), lengths), np.flatnonzero(lengths)
            starts = (np.cumsum(lengths) - lengths)[some]
            by = np.argsort(number)
            first = np.flatnonzero(np.append(True, np.diff(number[by]) != 0))
            used = number[by][first]
            vx = v[number] * x[:, None]
            total, squares, z = np.zeros((len(part), FACTORS), np.float32), np.zeros(len(part)), np.full(len(part), b)
            total[some], squares[some] = np.add.reduceat(vx, starts), np.add.reduceat((vx * vx).sum(1), starts)
            z[some] += np.add.reduceat(w[number] * x, starts)
            z += 0.5 * ((total**2).sum(1) - squares)
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) * weights[part] / len(part)).astype(np.float32)
            gx = g[owner] * x
            dw = np.add.reduceat(gx[by], first)
            dv = np.add.reduceat((gx[:, None] * (total[owner] - vx))[by], first)
            gw[used] += dw**2
            gv[used] += dv**2
            for table, step, slope in ((w, rate / np.sqrt(gw[used]), dw), (v, 0.3 * rate / np.sqrt(gv[used]), dv)):
                moved = table[used] - step * slope
                table[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            gb += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(gb)
    out_w[active], out_v[active] = w, v
    return FactorizationMachine(float(b), out_w, out_v)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, sample: int, folds: int | None = None) -> DataFrame:
    """(doc_id, label, weight): at most ``sample`` rows of each class; weight: rows of the class for each one taken.

    With ``folds``, rows whose id falls in fold 0 are never taken.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    if folds:
        known = known.where(fold_of(F.col("doc_id"), folds) != 0)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        n = sizes.get(label, 0)
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("weight", F.lit(float(max(1.0, n / sample))))
        picked = part if picked is None else picked.union(part)
    return picked


def one_row_each(docs: DataFrame, picked: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, text, label, weight): of each picked id one row, the text that sorts first; as many rows as ids at most."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct("text", "label", "weight")).alias("r"))
    return one.select("doc_id", "r.text", "r.label", "r.weight")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE, folds: int | None = FOLDS) -> FactorizationMachine:
    """Trains on ``labels.toxic`` of rows outside fold 0."""
    picked = labelled_sample(docs, labels, "toxic", sample, folds)
    texts = one_row_each(docs, picked, text_col)

    def run(batches):
        cache = WordTerms()
        for batch in batches:
            found = [terms(t, cache) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([n for n, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["doc_id", "label", "weight", "numbers", "values"])

    table = texts.select("doc_id", "text", "label", "weight").mapInArrow(run, "doc_id long, label int, weight double, numbers array<int>, values array<float>").toArrow().sort_by("doc_id")
    flat = [table.column(c).combine_chunks() for c in ("numbers", "values")]
    offsets = flat[0].offsets.to_numpy() if len(table) else np.zeros(1, np.int32)
    numbers, values = ((c.values if len(table) else c).to_numpy(zero_copy_only=False) for c in flat) if len(table) else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    rows = [(numbers[a:b], values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]  # views
    return train(rows, table.column("label").to_numpy().astype(np.float64), table.column("weight").to_numpy())


def score_documents(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fm, cache = sent.value, WordTerms()
        for batch in slices(batches):
            score = [fm.score(*terms(t, cache)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is under 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    own = docs.columns.index(text_col)

    def run(batches):
        fm, cache = sent.value, WordTerms()
        for batch in slices(batches):
            texts = batch.column(own).to_pylist()
            yield batch.filter(pa.array([fm.score(*terms(t, cache)) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
