"""Token counts without token ids: each distinct pre-token is counted once.

A text's count is the sum over its pre-tokens, the pieces that the tokenizer's own normaliser and
pre-tokenizer cut it into. The pre-tokens of the corpus are gathered with their frequencies, each distinct
one goes through the library's model once, and the counts come back to the documents by a join on the
pre-token's 128-bit hash. The most frequent ones go to the executors as a table of bounded size
(20 bytes each); only the rest of each document's pre-tokens is shuffled, with their frequencies in
the document, so no pre-token that fills a large part of the corpus meets in one task. Words over
``LONG_WORD`` bytes and words that hold a special token's string are counted where they stand.

Null text: as empty. Empty text: 0 tokens. Null, negative or repeated ids: kept as they are; rows that
repeat both id and text: one result each. Very long texts: read in chunks. Equal frequencies at the edge of
the table that is sent: either way of counting gives the same. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LARGE_CHUNK, Runs, grouped, most_frequent, slices, word_chunks, written
from .pre_tokens import PreTokens

#: The table sent to executors holds at most so many pre-tokens: 42 MB.
HOT = 1 << 21
LONG_WORD = 256
#: A task's own counts are passed on when so many distinct words, or bytes of them, have gathered; rows go out in small batches.
FLUSH_WORDS, FLUSH_BYTES, OUT_ROWS = 1 << 18, 8 << 20, 1 << 14
#: Rows of documents' rarer pre-tokens that go out at once.
FLUSH_ROWS = 1 << 16

_SPLITTERS: dict[str, PreTokens] = {}


def splitter(path: str) -> PreTokens:
    """The worker's own, kept from task to task."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = PreTokens(path)
    return _SPLITTERS[path]


def digests(keys: list[str]) -> np.ndarray:
    """The 128-bit hashes as rows of two signed numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys), "<i8").reshape(-1, 2)


def distinct_pre_tokens(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(word string, freq long) over the pre-tokens of all words of up to LONG_WORD bytes."""

    def run(batches):
        pre = splitter(tokenizer_file)
        place: dict[int, int] = {}
        texts: list[bytes] = []
        counts, size = np.zeros(FLUSH_WORDS, np.int64), 0

        def out():
            total: dict[str, int] = {}
            for word, n in zip(texts, counts[: len(texts)].tolist(), strict=True):
                for p in pre.split(word) or () if len(word) <= LONG_WORD else ():
                    total[p] = total.get(p, 0) + n
            keys, freq = list(total), list(total.values())
            for low in range(0, len(keys), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + OUT_ROWS], pa.string()), pa.array(freq[low : low + OUT_ROWS], pa.int64())], ["word", "freq"])

        for batch in slices(batches):
            for words in word_chunks(batch.column(0), lower=False, most=LARGE_CHUNK):
                hashes, at, n, _ = grouped(words.hash)
                for low in range(0, len(hashes), 1 << 14):
                    if len(texts) > FLUSH_WORDS - (1 << 14) or size > FLUSH_BYTES:
                        yield from out()
                        place, texts, size = {}, [], 0
                        counts[:] = 0
                    where = []
                    for h, i in zip(hashes[low : low + (1 << 14)].tolist(), at[low : low + (1 << 14)].tolist(), strict=True):
                        k = place.get(h)
                        if k is None:
                            k = place[h] = len(texts)
                            long = words.end[i] - words.start[i] > LONG_WORD
                            texts.append(b"" if long else words.word(i))
                            size += len(texts[-1])
                        where.append(k)
                    counts[where] += n[low : low + (1 << 14)]
        yield from out()

    return docs.select("text").mapInArrow(run, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def pre_token_pieces(words: DataFrame, tokenizer_file: str) -> DataFrame:
    """(h1, h2, freq, pieces): each distinct pre-token through the library's model once."""

    def run(batches):
        pre = splitter(tokenizer_file)
        for batch in batches:
            found = batch.column(0).to_pylist()
            h = digests(found)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(1), pa.array(list(map(pre.count, found)), pa.int32())], ["h1", "h2", "freq", "pieces"])

    return words.mapInArrow(run, "h1 long, h2 long, freq long, pieces int")


class WordCosts:
    """For each word, the pieces that are known at hand, and the pre-tokens to be asked for."""

    def __init__(self, pre: PreTokens, h1: np.ndarray, h2: np.ndarray, pieces: np.ndarray):
        self.pre, order = pre, np.argsort(h1)
        self.h1, self.h2, self.pieces = h1[order], h2[order], pieces[order]
        self.clear()
        self.runs = Runs(self.make, np.int64)

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.asked = np.zeros((0, 2), np.int64)

    def make(self, words: list[bytes]) -> list[list[int]]:
        """Runs: the pieces known, then the numbers of the pre-tokens to be asked for, in ``asked``."""
        if not len(self.runs.start):
            self.clear()
        split = [self.pre.split(w) if len(w) <= LONG_WORD else None for w in words]
        keys = list({p for s in split if s for p in s})
        h = digests(keys)
        at = np.minimum(np.searchsorted(self.h1, h[:, 0]), max(len(self.h1) - 1, 0))
        known = (self.h1[at] == h[:, 0]) & (self.h2[at] == h[:, 1]) if len(self.h1) else np.zeros(len(keys), bool)
        pieces = dict(zip(np.array(keys, object)[known].tolist(), self.pieces[at[known]].tolist(), strict=True))
        new = [i for i in np.flatnonzero(~known).tolist() if keys[i] not in self.number]
        self.number.update((keys[i], len(self.asked) + n) for n, i in enumerate(new))
        self.asked = np.concatenate([self.asked, h[new]])
        out = []
        for word, parts in zip(words, split, strict=True):
            if parts is None:
                out.append([len(self.pre.whole(word))])
            else:
                out.append([sum(pieces.get(p, 0) for p in parts), *(self.number[p] for p in parts if p not in pieces)])
        return out


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    vocabulary = written(pre_token_pieces(distinct_pre_tokens(docs, tokenizer_file), tokenizer_file))
    top = most_frequent(vocabulary, "freq", hot_words, ["h1", "h2", "pieces"])
    hot = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("h1", "h2", "pieces")))

    def run(batches):
        costs = WordCosts(splitter(tokenizer_file), *hot.value)
        for batch in slices(batches):
            ids, texts, n = batch.column(0), batch.column(1), batch.num_rows
            known, owners, asked, freq = np.zeros(n, np.int64), [], [], []
            for words in word_chunks(texts, lower=False, most=LARGE_CHUNK):
                numbers, length = costs.runs.numbers(costs.runs.places(words))
                owner, first = np.repeat(words.owner, length), np.zeros(len(numbers), bool)
                first[np.cumsum(length) - length] = True
                known += np.bincount(owner[first], numbers[first], n).astype(np.int64)
                if not first.all():
                    key, _, times, _ = grouped(owner[~first] << 32 | numbers[~first])
                    owners.append(key >> 32)
                    asked.append(costs.asked[key & (1 << 32) - 1])
                    freq.append(times)
            data = [t or b"" for t in texts.to_pylist()]
            own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data)), "<i8").reshape(-1, 2)
            # a row of its own carries the document, and asks for nothing: its key is the text's, counted 0 times
            owner = np.concatenate([np.arange(n), *owners])
            h = np.concatenate([own, *asked])
            times = np.concatenate([np.zeros(n, np.int64), *freq])
            nothing = np.arange(len(owner)) >= n
            at = pa.array(owner)
            cols = [ids.take(at), pa.array(own[owner, 0]), pa.array(own[owner, 1]), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(times)]
            cols += [pa.array(np.array(list(map(len, data)), np.int64)[owner], mask=nothing), pa.array(known[owner], mask=nothing)]
            out = pa.RecordBatch.from_arrays(cols, ["doc_id", "d1", "d2", "h1", "h2", "freq", "n_bytes", "n"])
            for low in range(0, out.num_rows, FLUSH_ROWS):
                yield out.slice(low, FLUSH_ROWS)

    parts = docs.mapInArrow(run, "doc_id long, d1 long, d2 long, h1 long, h2 long, freq long, n_bytes long, n long")
    joined = parts.join(vocabulary.select("h1", "h2", "pieces"), ["h1", "h2"], "left")
    total = joined.groupBy("doc_id", "d1", "d2").agg(F.sum(F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("asked"), F.count("n").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("n").alias("n"))
    # rows that repeat id and text have asked for the same
    each = total.select("doc_id", "n_bytes", (F.col("n") + F.expr("asked div copies")).alias("n_tokens"), F.explode(F.expr("sequence(1, copies)")).alias("_copy"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
