"""Benchmark decontamination: which short test items stand, whole or nearly, inside which documents.

A text's shingles are its distinct windows of five lower-cased words (with fewer words, the whole
sequence as one). An item is found in a document if the document contains at least 0.8 of its
shingles.

Containment search by size-partitioned MinHash: items are partitioned by the power of two of their
number of shingles. A partition whose largest item has n shingles keeps, of each item, the k smallest
shingle hashes, k = floor(0.2 n) + 1. A document that contains 0.8 of an item misses at most
floor(0.2 n) of its shingles, so it shares at least one of those k hashes (k - misses, in general):
the sketch size follows from the partition's size bound and the search has no false negatives. On the
document's side a partition's sketch is all hashes under the largest that any of its items keeps, which is the same
sampling rate; documents smaller than an item's bound are passed over. Candidates are then verified
by exact shingle containment on the words themselves.

Items are few and short next to the corpus. They go to the executors in blocks of ``BLOCK_BYTES`` of
text, a longer item in a block of its own, each block against all documents in a narrow pass; there is no shuffle, so
copies, hot sources or a passage in every document move nothing. Items of equal text are one in their block.

Null or empty text: no shingles, neither found nor finding. Repeated documents, and null, negative or repeated ids: a row each. Repeated
items: a row each. Very long documents and items: taken whole. Ties: an item at exactly 0.8 is found. Empty tables: no rows found, all documents kept.
Extra columns: ignored by :func:`contained_items`, kept by :func:`drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, hashed_words, shingle_hashes, slices, word_hashes

WORDS = 5
PERCENT = 80
BLOCK_BYTES = 16 << 20

SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def _need(n: int, percent: int) -> int:
    """Shingles that a document must share with an item of n."""
    return -(-n * percent // 100)


def _windows(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return set(zip(*(words[j:] for j in range(k)))) if len(words) >= k else {tuple(words)}


class Sketches:
    """The size-partitioned sketches of a block of items; small, and sent to every executor."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = WORDS, percent: int = PERCENT):
        self.k, self.percent = k, percent
        ids: dict[bytes, list] = defaultdict(list)
        for i, t in items:
            ids[t].append(i)
        cache = WordHashes()
        found = [(t, np.unique(shingle_hashes(word_hashes(t.lower().split(), cache), k))) for t in ids]
        self.items = [(ids[t], len(h), _windows(t.lower().split(), k)) for t, h in found]
        by_size: dict[int, list[int]] = defaultdict(list)
        for at, (_, h) in enumerate(found):
            if len(h):
                by_size[len(h).bit_length()].append(at)
        self.hits_needed = np.zeros(len(found), np.int64)
        #: Of each size: the kept hashes in order, and the items that keep each.
        self.parts = []
        for places in by_size.values():
            top = max(len(found[at][1]) for at in places)
            kept: dict[int, list[int]] = defaultdict(list)
            for at in places:
                h = found[at][1]
                n = len(h)
                size = min(n, top - _need(top, percent) + 1)
                self.hits_needed[at] = max(1, size - (n - _need(n, percent)))
                for x in h[:size].tolist():
                    kept[x].append(at)
            hashes = np.array(sorted(kept), np.uint64)
            self.parts.append((hashes, [kept[x] for x in hashes.tolist()]))

    def find(self, text: bytes, h: np.ndarray) -> list[tuple[int, int]]:
        """(item's place, shingles shared) of all items that the text contains; h: the hashes of its shingles."""
        found, own = [], None
        for hashes, owners in self.parts:
            low = np.unique(h[h <= hashes[-1]])
            at = np.searchsorted(hashes, low)
            counts = Counter(owner for x in at[hashes[at] == low].tolist() for owner in owners[x])
            for item, n in counts.items():
                _, size, shingles = self.items[item]
                if n >= self.hits_needed[item] and len(h) >= _need(size, self.percent):
                    own = _windows(text.lower().split(), self.k) if own is None else own
                    shared = len(shingles & own)
                    if shared * 100 >= self.percent * len(shingles):
                        found.append((item, shared))
        return found

    def search(self, texts: pa.Array):
        """(row, item's place, shingles shared) of all texts."""
        hashes, counts = hashed_words(texts)
        ends = np.cumsum(counts)
        for row in np.flatnonzero(counts).tolist() if self.parts else ():
            h = shingle_hashes(hashes[ends[row] - counts[row] : ends[row]], self.k)
            text = None
            for hashes_, _ in self.parts:
                if text is None and len(h) and h.min() <= hashes_[-1]:
                    text = texts[row].as_py()
            if text is not None:
                for item, shared in self.find(text, h):
                    yield row, item, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """Items as lists for the driver, a block of bounded size at a time; an item over that is alone."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    block, texts, size = [], set(), 0
    for r in rows.toLocalIterator():
        text = bytes(r.t)
        more = 0 if text in texts else len(text)
        if block and size + more > block_bytes:
            yield block
            block, texts, size = [], set(), 0
        block.append((r.i, text))
        texts.add(text)
        size += len(text) if more or not size else 0
    yield block


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_item, n_shared, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(Sketches(block, k, percent))

        def run(batches, sent=sent):
            sketches = sent.value
            for batch in slices(batches):
                found = [(row, i, sketches.items[item][1], n) for row, item, n in sketches.search(batch.column(1)) for i in sketches.items[item][0]]
                row, i, size, n = zip(*found) if found else ((), (), (), ())
                cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (i, size, n)), pa.array([a / b for a, b in zip(n, size, strict=True)], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that contain none of the items."""
    spark, own = docs.sparkSession, docs.columns.index(text_col)
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(Sketches(block, k, percent))

        def run(batches, sent=sent):
            sketches = sent.value
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in sketches.search(batch.column(own).cast(pa.binary()))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
