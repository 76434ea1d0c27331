"""Quality rules learned as gradient-boosted trees over document statistics.

A fixed rule fails a document first: fewer than 20 words, or over 30 % of its words inside 8-word windows
that occur twice or more. The others are judged by trees fitted to ``labels.quality``: histogram
splits on the logistic loss, of small depth, with monotonic constraints, so that more symbols, more
repeated lines, words or windows can never raise a score. The trees are flattened into numpy arrays
(feature, threshold, left, right, value) and a batch of documents descends all of them at once.

They are fitted on the driver to the statistics of at most ``SAMPLE`` labelled ids of each class, taken
in the order of a hash of their ids and weighted back to the classes' true shares, and one row of each id. The arrays are a few
KB; scoring is one narrow pass over whole texts, whatever their length.

Words are runs of bytes other than ASCII white space. Null or empty text: no words, fails the fixed rule.
No labelled rows of one class: the trees are empty and the fixed rule alone decides. Null, negative and repeated ids, repeated rows: a
row each; an id that stands on several texts teaches by the text that sorts first. Ties: a score of 0.5 is kept; of equal splits the first feature's.
Empty table: no rows. Extra columns: ignored by :func:`judge`, kept by :func:`drop_failed`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import grouped, hashed_words, shingle_hashes, slices
from .toxicity import labelled_sample, one_row_each

LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
SAMPLE = 10_000

#: Statistics that the trees see, and how a higher value may move the score (-1: only down, 0: freely).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "stutter_share": -1,
    "distinct_share": 0,
    "upper_share": 0,
    "bang_per_word": -1,
    "digit_share": 0,
    "top_word_share": 0,
    "words_per_line": 0,
}

#: Bytes that begin no code point of a word: white space, and the later bytes of longer code points.
_NO_CHARACTER = bytes([*b" \t\n\r\x0b\x0c", *range(0x80, 0xC0)])

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def statistics(data: bytes, ids: np.ndarray) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the FEATURES of a whole text; ids: the hashes of its words."""
    n = len(ids)
    chars = len(data.translate(None, _NO_CHARACTER))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > WINDOW:
        _, _, count, at = grouped(shingle_hashes(ids, WINDOW))
        first = np.flatnonzero(count[at] >= 2)
        if len(first):
            edge = np.zeros(n + 1, np.int64)
            edge[first] += 1
            edge[first + WINDOW] -= 1
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    each, letters = max(n, 1), max(chars, 1)
    kinds, _, counts, _ = grouped(ids)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    stutter = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    features = [np.log1p(n), chars / each, symbols / each, dup / max(len(lines), 1), repeated / each, stutter / each, len(kinds) / each, upper / letters, data.count(b"!") / each, digits / letters, int(counts.max()) / each if n else 0.0, n / max(len(lines), 1)]
    return (n, chars, symbols, dup, repeated), features


def all_statistics(texts: pa.Array) -> list[tuple[tuple[int, int, int, int, int], list[float]]]:
    """The statistics of each text."""
    hashes, counts = hashed_words(texts, lower=False)
    ends = np.cumsum(counts)
    return [statistics(t or b"", hashes[e - n : e]) for t, e, n in zip(texts.to_pylist(), ends.tolist(), counts.tolist(), strict=True)]


def base_fails(n: int, repeated: int) -> bool:
    return n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n


class Trees:
    """Boosted trees as flat arrays; node 0 of each tree is its root and a leaf points at itself."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.bias, self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.depth = bias, feature, threshold, left, right, value, roots, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        if not len(x):
            return np.zeros(0)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(1))))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, monotone: list[int], n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, shrink: float = 1.0, least: float = 4.0) -> Trees:
    """Histogram gradient boosting with monotonic constraints, kept by bounds on each node's value."""
    nodes: list[list[float]] = []
    roots: list[int] = []
    share = float((y * weight).sum() / weight.sum()) if len(y) else 1.0
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0
    if 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        z = np.full(len(y), bias)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            at = len(nodes)
            value = float(np.clip(-g.sum() / (h.sum() + shrink), low, high))
            nodes.append([0, np.inf, at, at, rate * value])
            best = (1e-6, None)
            if level < depth:
                whole = g.sum() ** 2 / (h.sum() + shrink)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g, len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h, len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(e) + 1))[:-1]
                    gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
                    gain = gl**2 / (hl + shrink) + gr**2 / (hr + shrink) - whole
                    vl, vr = np.clip(-gl / (hl + shrink), low, high), np.clip(-gr / (hr + shrink), low, high)
                    bad = (nl < least) | (nr < least) | (monotone[f] * (vr - vl) < 0)
                    gain[bad] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                z[rows] += nodes[at][4]
                return at
            f, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[monotone[f]]
            goes = binned[rows, f] <= k
            nodes[at] = [f, edges[f][k], grow(rows[goes], level + 1, *bounds[0]), grow(rows[~goes], level + 1, *bounds[1]), 0.0]
            return at

        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-z))
            grad, hess = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
            roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    table = np.array(nodes if nodes else [[0, np.inf, 0, 0, 0.0]])
    return Trees(bias, table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots or [0]), depth)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE, folds: int | None = None) -> Trees:
    """Fits the trees to ``labels.quality``; with ``folds``, without the rows of fold 0."""
    picked = labelled_sample(docs, labels, "quality", sample, folds)
    texts = one_row_each(docs, picked, text_col)

    def run(batches):
        for batch in slices(batches):
            found = [x for _, x in all_statistics(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "weight", "x"])

    table = texts.select("doc_id", F.col("text").cast("binary").alias("text"), "label", "weight").mapInArrow(run, "doc_id long, label int, weight double, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return train(x, table.column("label").to_numpy().astype(float), table.column("weight").to_numpy(), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, the fixed rule's verdict and the final one for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            found = all_statistics(batch.column(1))
            score = sent.value.score(np.array([f for _, f in found]))
            failed = np.array([base_fails(c[0], c[4]) for c, _ in found], bool)
            counts = [pa.array([c[j] for c, _ in found], pa.int64()) for j in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed), pa.array(~failed & (score >= 0.5), pa.bool_()), pa.array(score, pa.float64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def drop_failed(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are kept."""
    sent, own = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            found = all_statistics(batch.column(own).cast(pa.binary()))
            failed = np.array([base_fails(c[0], c[4]) for c, _ in found], bool)
            yield batch.filter(pa.array(~failed & (sent.value.score(np.array([f for _, f in found])) >= 0.5), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
