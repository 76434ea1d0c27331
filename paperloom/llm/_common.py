"""Helpers that the operators of this subpackage share: checkpoints, word hashing and components.

A *word* is a maximal run of bytes other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``), which is what ``bytes.split()`` yields; lower-casing touches A-Z only,
as ``bytes.lower()`` does. Both run in C and never look at Unicode tables.
"""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..state import checkpointed, shared_dir

#: Words kept in a worker's dictionary before it starts anew; longer words are never kept.
CACHE_WORDS = 1 << 18
CACHE_LENGTH = 64
#: Texts that a worker unpacks from a batch at once.
SLICE = 512


_SCOPES: list[list[str]] = [[]]


@contextmanager
def tables_of(mine: list[str]):
    """Tables that :func:`written` makes inside go on this list, for :func:`release` to delete when their result is stored."""
    _SCOPES.append(mine)
    try:
        yield mine
    finally:
        _SCOPES.remove(mine)


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back; for larger tables, whose columns are read apart.

    A result that reads the table needs it: outside :func:`tables_of` it stays as long as the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    sweep(spark)
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no plan can reach any more; it finds them when the driver collects its garbage, which may be never."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


_SENT: list[list] = []


def send(spark: SparkSession, value):
    """Broadcasts a value of bounded size."""
    sent = spark.sparkContext.broadcast(value)
    if _SENT:
        _SENT[-1].append(sent)
    return sent


@contextmanager
def sent_within():
    """What :func:`send` broadcasts inside is forgotten at the end, everywhere: all that reads it must be stored by then."""
    _SENT.append([])
    try:
        yield
    finally:
        for sent in _SENT.pop():
            sent.destroy()


def discard(table: DataFrame) -> None:
    """Deletes a table that :func:`written` made, once nothing that is still to run reads it."""
    for scope in _SCOPES:
        if table._loom_path in scope:
            scope.remove(table._loom_path)
    release(table.sparkSession, [table._loom_path])


def release(spark: SparkSession, tables: list[str]) -> None:
    """Deletes these tables; call it when the results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while tables:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)


#: Bins of a histogram of frequencies, to each doubling.
_BINS = 16


def most_frequent(counts: DataFrame, freq: str, most: int, columns: list[str]):
    """An Arrow table of ``most`` rows at most: the highest frequencies, to a sixteenth of a doubling.

    The driver sees a histogram of the logarithms of frequencies (a thousand bins at most, whatever the data),
    then the rows of the whole bins that fit and, of the next bin, a share by hash. Callers have
    another way for all other rows, so that the choice changes no result.
    """
    place = F.floor(F.log2(F.col(freq).cast("double")) * _BINS).cast("int")
    part = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1 << 20))
    sizes = counts.groupBy(place.alias("f")).agg(F.count("*").alias("n")).collect()
    lowest, total, share = 1 << 20, 0, 0
    for f, n in sorted(((r.f, r.n) for r in sizes), reverse=True):
        if total + n > most:
            share = (most - total) * (1 << 20) // n
            break
        lowest, total = f, total + n
    chosen = counts.where((place >= lowest) | ((place == F.lit(f)) & (part < share))) if sizes else counts
    return chosen.select(columns).limit(most).toArrow()


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def slices(batches, size: int = SLICE):
    """The batches in slices of a few rows, so that only these are unpacked to Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            yield batch.slice(low, size)


#: Keys to each bucket of fingerprints, and to a row of them at most.
BUCKET_KEYS = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _S33)) * _MIX1
    h = (h ^ (h >> _S33)) * _MIX2
    return h ^ (h >> _S33)


#: Bytes of text whose words are hashed at once, and where each chunk costs something besides; a longer text is cut at white space.
CHUNK, LARGE_CHUNK = 1 << 18, 1 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte, and the same with A-Z as a-z: a word's hash is a polynomial in them.
_CASED = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWER = _CASED.copy()
_LOWER[65:91] = _CASED[97:123]
_ROOT = 0xD1342543DE82EF95
_POWERS = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _powers(n: int, forward: bool) -> np.ndarray:
    """The first n powers (modulo 2^64) of an odd number, or of its inverse; those of a chunk are kept."""
    if len(_POWERS[forward]) < n:
        root = _ROOT if forward else pow(_ROOT, -1, 1 << 64)
        kept = next((size for size in (CHUNK + 1, LARGE_CHUNK + 1) if n <= size), 0)
        steps = np.full(max(n, kept), root, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if not kept:
            return made
        _POWERS[forward] = made
    return _POWERS[forward][:n]


def binary_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets in them, without a copy; nulls are empty."""
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return found, at


class Words:
    """The words of a chunk of texts: byte ``start`` and ``end`` in ``data``, the text's row as ``owner``, and a 64-bit ``hash``.

    The chunk has ``rows`` texts from row ``first_row`` on; a long text comes in several chunks, of which only the last ``ends`` it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int, lower: bool, ends: bool = True):
        self.first_row, self.rows, self.ends = first_row, len(offsets) - 1, ends
        space, n = SPACE[data], len(data)
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:], last[:-1] = space[:-1], space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = True
        last[inner - 1] = True
        self.data = data
        self.start, self.end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
        self.owner = np.searchsorted(offsets, self.start, "right") - 1 + first_row
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _CASED)[data] * _powers(n, True), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers(n, False)[self.start] if n else np.zeros(0, np.uint64)
        self.hash = mixed(h + (self.end - self.start).astype(np.uint64) * _STEP)

    def word(self, at: int) -> bytes:
        return self.data[self.start[at] : self.end[at]].tobytes()


def _cut(data: np.ndarray, low: int, high: int, most: int) -> int:
    """Where to cut a long text: after the last white space of its next ``most`` bytes, or after the first beyond."""
    cut = min(low + most, high)
    if cut < high and len(spaces := np.flatnonzero(SPACE[data[low:cut]])):
        return low + int(spaces[-1]) + 1
    while cut < high:
        if len(spaces := np.flatnonzero(SPACE[data[cut : min(cut + most, high)]])):
            return cut + int(spaces[0]) + 1
        cut = min(cut + most, high)
    return high


def word_chunks(texts: pa.Array, lower: bool = True, most: int = CHUNK):
    """The words of all texts in order, in chunks of up to ``most`` bytes."""
    data, offsets = binary_parts(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[end])
        if high - low <= most:
            yield Words(data[low:high], offsets[row : end + 1] - low, row, lower)
        else:  # one long text
            while low < high:
                cut = _cut(data, low, high, most)
                yield Words(data[low:cut], np.array([0, cut - low]), row, lower, cut == high)
                low = cut
        row = end


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for words in word_chunks(texts, lower):
        hashes.append(words.hash)
        counts += np.bincount(words.owner, minlength=len(texts))
    return np.concatenate(hashes), counts


class WordHashes(dict):
    """word -> its hash, as :class:`Words` has it for lower-cased words; remembers short words up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        value = int(Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), 0, False).hash[0])
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, a place of each, how often, each value's number among them)."""
    order = np.argsort(values)
    there = values[order]
    first = np.ones(len(values), bool)
    first[1:] = there[1:] != there[:-1]
    starts = np.flatnonzero(first)
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(first) - 1
    return there[starts], order[starts], np.diff(np.append(starts, len(values))), number


class Runs:
    """word -> a run of numbers, kept in flat arrays and found by the word's hash; starts anew beyond a fixed size.

    ``make(words)`` gives the runs of words that aren't there, as lists.
    """

    def __init__(self, make, kind, words: int = CACHE_WORDS, numbers: int = 1 << 22):
        self.make, self.kind, self.most_words, self.most_numbers = make, kind, words, numbers
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def places(self, words: Words) -> np.ndarray:
        """Each word's place in ``start`` and ``length``."""
        hashes, at, _, number = grouped(words.hash)
        keys = hashes.tolist()
        found = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new) and (len(self.index) + len(new) > self.most_words or len(self.pool) > self.most_numbers):
            self.clear()
            new = np.arange(len(keys))
        if len(new):
            made = self.make([words.word(i) for i in at[new].tolist()])
            length = np.fromiter(map(len, made), np.int64, len(made))
            found[new] = np.arange(len(self.start), len(self.start) + len(new))
            self.index.update(zip(hashes[new].tolist(), found[new].tolist(), strict=True))
            self.start = np.append(self.start, len(self.pool) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.pool = np.append(self.pool, np.fromiter(chain.from_iterable(made), self.kind, int(length.sum())))
        return found[number]

    def numbers(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places end to end, and their lengths."""
        length = self.length[places]
        at = np.repeat(self.start[places] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        return self.pool[at], length


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words in order; with fewer words, of the whole sequence; none without words."""
    n = len(ids)
    if n == 0:
        return ids
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = h * _STEP + ids[j : n - width + 1 + j]
    return mixed(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size with the numbers in column ``place`` set; the driver gets at most bits / 64 words."""
    words = places.select(F.expr("cast(place div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("b"))
    return _gathered_bits(words, bits)


def _gathered_bits(words: DataFrame, bits: int) -> np.ndarray:
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out


def is_set(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys' places in a bitmap, by their first 48 bits, which fingerprints have."""
    return (mixed(keys >> np.uint64(16)) & np.uint64(bits - 1)).astype(np.int64)


def repeated(rows: DataFrame, keys_of, total: int, bits: int) -> np.ndarray:
    """A bitmap of the places of 64-bit keys that occur twice or more, and of few others.

    ``keys_of(batches)`` yields arrays of keys; ``total`` is about how many there are. Tasks send the keys' first 48 bits, four bytes a key
    as 16 bits of a bucket's keys are mostly alike and go as runs, and a bucket's are sorted together; buckets are as many as it takes.
    """
    buckets = 1 << min(16, max(4, int(total // BUCKET_KEYS).bit_length()))

    def send(batches):
        for keys in keys_of(batches):
            key = np.sort(keys)
            key = np.concatenate([key[:2], key[2:][key[2:] != key[:-2]]])  # two of each at most
            tops = (key >> np.uint64(48)).astype(np.uint16)
            prints = (key >> np.uint64(16)).astype(np.uint32)
            bucket = tops % buckets if buckets < 1 << 16 else tops
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                here = by[cuts[b] : cuts[b + 1]]
                top, _, runs, _ = grouped(tops[here])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (top, runs.astype("<u4"), prints[here]))], ["bucket", "tops", "runs", "prints"])

    def meet(table: pa.Table) -> pa.Table:
        tops, runs, prints = (table.column(c).to_pylist() for c in ("tops", "runs", "prints"))
        top = np.concatenate([np.repeat(np.frombuffer(t, np.uint16), np.frombuffer(r, "<u4")) for t, r in zip(tops, runs, strict=True)])
        keys = (top.astype(np.uint64) << np.uint64(32)) | np.concatenate([np.frombuffer(p, np.uint32) for p in prints])
        keys.sort()
        place, _, _, _ = grouped(places(keys[1:][keys[1:] == keys[:-1]] << np.uint64(16), bits))
        word, _, _, at = grouped(place >> 6)
        found = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(found, at, np.uint64(1) << (place & 63).astype(np.uint64))
        return pa.table({"w": pa.array(word.astype(np.int32)), "b": pa.array(signed(found))})

    sent = rows.mapInArrow(send, "bucket int, tops binary, runs binary, prints binary")
    return _gathered_bits(sent.groupBy("bucket").applyInArrow(meet, "w int, b long"), bits)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Alternating large-star and small-star rounds: each round is two aggregations and joins whose
    hot keys the engine can split, the number of edges never grows, and the number of rounds is
    logarithmic in practice. Edges live in the shared checkpoint folder between rounds; nothing
    but a count and a checksum reaches the driver.
    """
    x, y = F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    cur = checkpointed(edges.where(F.col(a) != F.col(b)).select(x, y).distinct())
    seen = None
    while True:
        mark = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("x", "y") % 1_000_003)).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = cur.union(cur.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x and y > m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(low, "x")
        small = joined.where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        cur = checkpointed(small.union(low.select("x", F.col("m").alias("y"))).distinct())
    nodes = cur.groupBy("x").agg(F.min("y").alias("root")).select(F.col("x").alias("node"), "root")
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
