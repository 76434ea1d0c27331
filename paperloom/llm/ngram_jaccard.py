"""N-gram Jaccard join: groups of documents whose sets of three-word shingles overlap by 90 % or more.

The join is a blocked sparse product of the document by n-gram incidence matrix with its transpose.
Only the entries that can matter are ever multiplied:

1. Documents with equal sets are one row of the matrix (a class, named by a 128-bit digest of the
   set), however many copies there are.
2. *Blocks by column.* Within a row the n-grams are ordered from rare to frequent. Two rows of n and m
   n-grams that link share at least ceil(90 (n + m) / 190) of them, so they share s = ``SHARED`` + n / ``EACH``
   (of the smaller n) among the first n - ceil(0.9 n) + s of either: only this prefix is dealt out, by n-gram, and one n-gram's rows are
   a block. A passage that many documents share is frequent, comes last in their order and stays out. A row
   takes part only if enough of its prefix is in any other's.
3. *Size-derived bounds.* A pair is discarded unless 0.9 n <= m <= n / 0.9; unless each has room for the other,
   as a row that has u n-grams before a shared one that stand in no other's prefix shares n - u at most; unless the n-grams left after the first
   shared one in both orders still reach the overlap that a link needs; and unless it shares s n-grams.
4. A pair that is left is held against a sketch of one parity bit for about each n-gram, from which the
   symmetric difference is so many at least; no link is lost by it and nearly all other pairs are.
5. Overlap counts are accumulated exactly, over the whole sets, for each pair that still stands.

A block of b rows isn't multiplied out at once. Its *pivot*, the row with the fewest n-grams of its own (the text that
the others were made from, where there is one: the same row in all of a group's blocks), is multiplied with the
others; rows linked to the pivot are in one component and need no product among themselves. Only blocks whose
rows are still in different components go on, gathered by pivot into *cells*: those of up to ``SMALL`` rows as pairs, larger ones
as products of two slabs of ``SLAB`` rows at most, of sketches first; whole sets go only to slabs, and only of rows, that have a
pair left. A task returns no more links than it has rows. No link between components is lost: every pair that is passed
over is out of bounds or already in one component.

The order needs frequencies, but any order that all rows agree on gives the same result: each ``COUNTED``
documents of a task are counted by themselves, counts of ``LOCAL`` or more are summed, and the
``HEAVY`` most frequent (a table of 16 MB) are sent to the executors; all others rank by their hash.

Null text, or no words: an empty set, linked with nothing; the component is the document's own id. Rows with a null id take
part and name no component unless all ids of it are null. Repeated rows, and ids that stand on several texts: a row each, linked by their own text. Very long
texts: one set each, in the memory of a task. Ties: the lowest id names a component. Empty table: no rows.
Extra columns: ignored by :func:`jaccard_components`, kept by :func:`one_of_each_group`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import bitmap, checkpointed, components, discard, hashed_words, is_set, most_frequent, places, repeated, send, sent_within, shingle_hashes, signed, slices, written

WORDS, PERCENT = 3, 90
#: An n-gram's count among so many documents of a task is passed on from here; at most so many n-grams rank by count.
COUNTED, LOCAL, HEAVY = 1 << 12, 4, 1 << 20
#: Prefixes are as long as it takes for linked rows to share so many n-grams in them, and one more for each so many of their size.
SHARED, EACH = 3, 20
#: Cells of up to so many rows are paired; the rows of larger ones are multiplied in slabs of so many.
SMALL, SLAB = 8, 1024
#: Bits of the filters that say which n-grams and documents are wanted: 8 MB. They only spare work.
FILTER_BITS = 1 << 26
#: Bits of a sketch: a power of two from this one on, up to this one.
SKETCH_BITS, SKETCH_MOST = 64, 1 << 16


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = hashed_words(texts)
    out, at = [], 0
    for n in counts.tolist():
        s = shingle_hashes(hashes[at : at + n], k)
        at += n
        s.sort()
        if len(s) > 1:
            first = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=first[1:])
            s = s[first]
        out.append(s)
    return out


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each of about as many places as there are shingles: whether an odd number of them falls there."""
    bits = SKETCH_BITS
    while bits < len(shingles) and bits < SKETCH_MOST:
        bits *= 2
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def prefix_length(n: int, percent: int) -> int:
    """Links between different sets need ten n-grams or more (at 90 %), so their overlap is over SHARED."""
    return min(n, n - -(-percent * n // 100) + SHARED + n // EACH)


def heavy_shingles(docs: DataFrame, k: int, local: int = LOCAL, heavy: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, counts) of the most frequent n-grams."""

    def run(batches):
        for batch in slices(batches, COUNTED):
            sets = [s for part in slices([batch]) for s in shingle_sets(part.column(0), k)]
            if sets:
                flat = np.concatenate(sets)
                sets.clear()
                flat.sort()
                often = flat[: len(flat) - local + 1][flat[: len(flat) - local + 1] == flat[local - 1 :]]
                h = often[np.append(True, often[1:] != often[:-1])] if len(often) else often
                n = np.searchsorted(flat, h, "right") - np.searchsorted(flat, h, "left")
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = written(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    top = most_frequent(counts, "n", heavy, ["h", "n"])
    discard(counts)
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(map(digest, sets)), "<i8").reshape(-1, 2)


def matrix_rows(docs: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(doc_id, d1, d2, n, prefix, sketch) of documents with words: the class, and the rare end of its n-grams.

    A copy of what the task has seen before comes without prefix and sketch.
    """

    def run(batches):
        (hot, counts), seen = heavy.value, set()
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), k)
            d = _digests(sets)
            at = [i for i, s in enumerate(sets) if len(s)]
            prefixes, sketches = [], []
            for i in at:
                s, name = sets[i], d[i].tobytes()
                if name in seen:
                    prefixes.append(None)
                    sketches.append(None)
                    continue
                if len(seen) >= 1 << 16:
                    seen.clear()
                seen.add(name)
                sketches.append(sketch(s))
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    often = np.where(hot[place] == s, counts[place], 0)
                    s = s[np.argsort(often, kind="stable")]
                prefixes.append(signed(s[: prefix_length(len(s), percent)]))
            sizes = [len(sets[i]) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(d[at, 0]), pa.array(d[at, 1]), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "d1", "d2", "n", "prefix", "sketch"])

    return docs.mapInArrow(run, "doc_id long, d1 long, d2 long, n long, prefix array<long>, sketch binary")


def block_entries(classes: DataFrame, percent: int, bits: int = FILTER_BITS) -> DataFrame:
    """(gram, cid, n, pos, own, top): the prefixes' entries, of classes that may link, without most n-grams that only one class has.

    ``own``: n-grams of the prefix that no other class has there. ``top``: the size that a linked class can have that also has this
    n-gram in its prefix, as it has none of the ``own`` ones before it.
    """
    spark = classes.sparkSession
    def keys_of(batches):
        for batch in batches:
            for part in slices([batch], 4096):
                yield part.column(0).flatten().to_numpy().view(np.uint64)

    total = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    sent = send(spark, repeated(classes.select("prefix"), keys_of, total, bits))

    def run(batches):
        wanted = sent.value
        for batch in batches:
            rows, grams = batch.num_rows, batch.column(2)
            offsets = grams.offsets.to_numpy().astype(np.int64)
            size = np.diff(offsets)
            owner, gram = np.repeat(np.arange(rows), size), grams.flatten().to_numpy()
            pos = np.arange(len(gram)) - (offsets[:-1] - offsets[0])[owner]
            keep = is_set(wanted, places(gram.view(np.uint64), bits))
            n = batch.column(1).to_numpy()
            least = -(-percent * n // 100)
            have = np.bincount(owner[keep], minlength=rows)
            own = size - have
            # of the n-grams before this one, those that no other has there are in no set that has this one in its prefix
            before = np.cumsum(keep) - keep
            apart = pos - (before - before[offsets[:-1][owner] - offsets[0]])
            top = ((100 + percent) * (n[owner] - apart) - percent * n[owner]) // percent
            keep &= (have >= SHARED + least // EACH)[owner] & (top >= least[owner])
            at = owner[keep]
            yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), batch.column(0).take(pa.array(at)), *(pa.array(x.astype(np.int64)) for x in (n[at], pos[keep], own[at], top[keep]))], ["gram", "cid", "n", "pos", "own", "top"])

    return classes.select("cid", "n", "prefix").mapInArrow(run, "gram long, cid long, n long, pos long, own long, top long")


def sketch_holds(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False only if the sets' symmetric difference is larger than a link allows."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (100 - percent) * (n + m)


def sketched(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with the digests of both, that their sketches don't discard."""
    one = classes.select("cid", "d1", "d2", "n", "sketch")
    both = pairs.join(one.toDF("a", "a1", "a2", "an", "as"), "a").join(one.toDF("b", "b1", "b2", "bn", "bs"), "b").select("a", "a1", "a2", "b", "b1", "b2", "an", "bn", "as", "bs")

    def run(batches):
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(6, 10))
            yield batch.filter(pa.array([sketch_holds(p, q, i, j, percent) for p, q, i, j in zip(x, y, n, m, strict=True)], pa.bool_())).select(range(6))

    return both.mapInArrow(run, "a long, a1 long, a2 long, b long, b1 long, b2 long")


def wanted_sets(docs: DataFrame, ids: DataFrame, k: int, bits: int = FILTER_BITS) -> DataFrame:
    """(d1, d2, shingles) of at least the classes in ``ids`` (d1, d2, low), read again from the document with the lowest id of each.

    The documents are found by a bitmap over ids and digests.
    """

    mask = bits - 1
    low = F.coalesce("low", F.lit(0))
    # a class by its digest and its lowest id; documents that aren't any class's lowest aren't split into words
    sent = send(docs.sparkSession, tuple(bitmap(ids.select(p.bitwiseAND(F.lit(mask)).alias("place")), bits) for p in (F.col("d1").bitwiseXOR(low), F.xxhash64("low"))))

    def run(batches):
        (by_class, by_id), seen = sent.value, set()
        for batch in slices(batches):
            texts = batch.filter(pa.array(is_set(by_id, batch.column(2).to_numpy())))
            sets = shingle_sets(texts.column(1), k)
            names = _digests(sets)
            wanted = is_set(by_class, (names[:, 0] ^ texts.column(0).fill_null(0).to_numpy()) & mask)
            if len(seen) >= 1 << 16:
                seen.clear()
            at = []
            for i in np.flatnonzero(wanted).tolist():
                name = names[i].tobytes()
                if len(sets[i]) and name not in seen:
                    seen.add(name)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(names[at, 0]), pa.array(names[at, 1]), pa.array([signed(sets[i]) for i in at], pa.list_(pa.int64()))], ["d1", "d2", "shingles"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(F.lit(mask)).alias("place")).mapInArrow(run, "d1 long, d2 long, shingles array<long>")


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose exact overlap makes a link. ``pairs`` is stored."""
    held = written(sketched(classes, pairs, percent))
    ids = classes.select("cid", "d1", "d2", "low").join(held.select(F.col("a").alias("cid")).union(held.select(F.col("b").alias("cid"))).distinct(), "cid", "left_semi")
    sets = wanted_sets(docs, ids, k)
    first = held.join(sets.toDF("a1", "a2", "sa"), ["a1", "a2"]).select("a", "b", "b1", "b2", "sa")
    both = first.join(sets.toDF("b1", "b2", "sb"), ["b1", "b2"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return checkpointed(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct())


def forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The edges (x, y) between n nodes that join what the edges before them don't."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def product_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of a left and a right slab, no more than join them: a spanning forest.

    The slabs' incidence matrix over the n-grams that two rows or more have, times its transpose.
    """
    sizes = np.array([len(s) for s in sets])
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = count[column] > 1
    owner, column, width = owner[keep], number[column[keep]], int((count > 1).sum())
    shared = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    step = 4096
    for low in range(0, width, step):  # blocks of columns, so that memory is bounded
        inside = (column >= low) & (column < low + step)
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        o, c = owner[inside], column[inside] - low
        a[at_left[o][at_left[o] >= 0], c[at_left[o] >= 0]] = 1
        b[at_right[o][at_right[o] >= 0], c[at_right[o] >= 0]] = 1
        shared += a @ b.T
    x, y = np.nonzero(100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared))
    return forest(left[x], right[y], len(sets))


def open_rows(sketches: list[bytes], n: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Places of the rows that have a pair between the slabs, of different roots, that bounds and sketches don't discard."""
    length = np.array([len(s) for s in sketches])
    keep = np.zeros(len(sketches), bool)
    for size in np.unique(length[left]).tolist():  # linked rows' sketches are of one length, or one twice the other
        for other in (size // 2, size, size * 2):
            i, j = left[length[left] == size], right[length[right] == other]
            if not len(i) or not len(j):
                continue
            width = min(size, other)
            fold = lambda x: (np.bitwise_xor(x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]) if x.shape[1] > width else x).view(np.uint64)
            a, b = (fold(np.frombuffer(b"".join(sketches[r] for r in rows.tolist()), np.uint8).reshape(len(rows), -1)) for rows in (i, j))
            for at in range(len(i)):
                r, m = i[at], n[j]
                good = (root[j] != root[r]) & (100 * m >= percent * n[r]) & (100 * n[r] >= percent * m)
                some = np.flatnonzero(good)
                if len(some):
                    apart = np.bitwise_count(b[some] ^ a[at]).sum(1, dtype=np.int64)
                    some = some[apart * (100 + percent) <= (100 - percent) * (n[r] + m[some])]
                    keep[j[some]] = True
                    keep[r] |= len(some) > 0
    return np.flatnonzero(keep)


def cell_links(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int, slab: int = SLAB) -> DataFrame:
    """(a, b): links that join the linked rows of each cell. ``members``: (cell, cid, root), stored."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / slab).cast("int").alias("slabs"))
    placed = members.join(sizes, "cell").withColumn("slab", F.pmod(F.xxhash64("cid"), F.col("slabs")).cast("int"))
    placed = placed.join(classes.select("cid", "d1", "d2", "n", "sketch", "low"), "cid")
    # a row goes to each pair of slabs that has its own
    pairs = F.transform(F.sequence(F.lit(0), F.col("slabs") - 1), lambda o: F.struct(F.least(o, F.col("slab")).alias("i"), F.greatest(o, F.col("slab")).alias("j")))
    dealt = placed.select("cell", "cid", "root", "slab", "d1", "d2", "n", "sketch", "low", F.explode(pairs).alias("p")).select("cell", "p.i", "p.j", "slab", "cid", "root", "d1", "d2", "n", "sketch", "low")

    def open_(table: pa.Table) -> pa.Table:
        slabs, n, root = (table.column(c).to_numpy() for c in ("slab", "n", "root"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        at = open_rows(table.column("sketch").to_pylist(), n, root, np.flatnonzero(slabs == i), np.flatnonzero(slabs == j), percent)
        return table.select(["cell", "i", "j", "slab", "cid", "d1", "d2", "low"]).take(pa.array(at, pa.int64()))

    left = written(dealt.groupBy("cell", "i", "j").applyInArrow(open_, "cell long, i int, j int, slab int, cid long, d1 long, d2 long, low long"))
    sets = wanted_sets(docs, left.select("d1", "d2", "low").distinct(), k)

    def run(table: pa.Table) -> pa.Table:
        ids, slabs = table.column("cid").to_pylist(), table.column("slab").to_numpy()
        at = list({x: n for n, x in enumerate(ids)}.values())  # a set may have been read from two documents
        ids, slabs = [ids[i] for i in at], slabs[at]
        sets = [np.asarray(table.column("shingles")[int(i)].values.to_numpy()) for i in at]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found = product_links(sets, np.flatnonzero(slabs == i), np.flatnonzero(slabs == j), percent)
        return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

    return checkpointed(left.join(sets, ["d1", "d2"]).groupBy("cell", "i", "j").applyInArrow(run, "a long, b long"))


def _pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows (x_ and y_) of one block each that share enough n-grams and are in bounds. A product's accumulated counts."""
    p, both = percent, 100 + percent
    # at the first n-gram that two rows share, what is left of both orders holds their whole overlap
    good = f"least(x_n - x_pos, y_n - y_pos) * {both} >= {p} * (x_n + y_n)"
    inside = f"x_cid != y_cid and 100 * x_n >= {p} * y_n and 100 * y_n >= {p} * x_n"
    named = entries.where(inside).groupBy(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b"))
    counted = named.agg(F.count("*").alias("shared"), F.max(F.expr("least(x_n, y_n)")).alias("smaller"), F.max(F.expr(good)).alias("good"), F.min(F.expr("x_n <= y_top and y_n <= x_top")).alias("room"))
    return counted.where(f"good and room and shared >= {SHARED} + smaller div {EACH}").select("a", "b")


def labelled_classes(docs: DataFrame, k: int, percent: int, heavy: int) -> DataFrame:
    """(d1, d2, root, low): the component of each class of documents (doc_id, text), and the lowest id of the class. A stored table."""
    with sent_within():
        return _labelled_classes(docs, k, percent, heavy)


def _labelled_classes(docs: DataFrame, k: int, percent: int, heavy: int) -> DataFrame:
    if percent < 75:
        raise ValueError("below 75 % two different sets may link by fewer n-grams than SHARED")
    order = send(docs.sparkSession, heavy_shingles(docs, k, heavy=heavy))
    one = matrix_rows(docs, k, percent, order).groupBy("d1", "d2")
    one = one.agg(F.first("n").alias("n"), F.first("prefix", True).alias("prefix"), F.first("sketch", True).alias("sketch"), F.min("doc_id").alias("low"))
    classes = written(one.withColumn("cid", F.monotonically_increasing_id()))

    entries = written(block_entries(classes, percent))
    pivots = entries.groupBy("gram").agg(F.count("*").alias("rows"), F.min(F.struct("own", "cid", "n", "pos", "top")).alias("p")).where("rows > 1")
    pivots = written(pivots.select("gram", F.col("p.cid").alias("y_cid"), F.col("p.n").alias("y_n"), F.col("p.pos").alias("y_pos"), F.col("p.top").alias("y_top")))
    x = entries.select("gram", *(F.col(c).alias(f"x_{c}") for c in ("cid", "n", "pos", "top")))
    tries = written(_pairs(x.join(pivots, "gram"), percent))
    roots = components(linked(docs, classes, tries, k, percent))

    # blocks whose rows are still in different components
    named = entries.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    split = named.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    left = named.join(split.join(pivots.select("gram", F.col("y_cid").alias("cell")), "gram"), "gram")
    # a row with fewer n-grams in such blocks than any link of it would share has none
    able = left.groupBy("cid").agg(F.count("*").alias("have"), F.first("n").alias("m")).where(f"have >= {SHARED} + ({percent} * m div 100) div {EACH}").select("cid")
    left = written(left.join(able, "cid").select("cell", "gram", "cid", "n", "pos", "top", "root"))
    cells = written(left.select("cell", "cid", "root").distinct())
    sizes = cells.groupBy("cell").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    small = left.join(sizes.where(f"rows <= {SMALL}").select("cell"), "cell", "left_semi")
    x, y = (small.select("cell", "gram", *(F.col(c).alias(f"{s}_{c}") for c in ("cid", "n", "pos", "top", "root"))) for s in "xy")
    pairs = _pairs(x.join(y, ["cell", "gram"]).where("x_root != y_root and x_cid < y_cid"), percent)
    pairs = written(pairs.join(tries, ["a", "b"], "left_anti"))
    large = written(cells.join(sizes.where(f"rows > {SMALL}").select("cell"), "cell", "left_semi"))
    none = tries.select("a", "b").where("false")
    more = none if pairs.isEmpty() else linked(docs, classes, pairs, k, percent)
    more = more if large.isEmpty() else more.union(cell_links(docs, classes, large, k, percent))
    # links between components, one for each two
    of = roots.withColumnRenamed("node", "n")
    ends = more.join(of.toDF("a", "ra"), "a", "left").join(of.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b").distinct()
    above = components(ends)
    found = classes.select("d1", "d2", "cid", "low").join(roots.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    labels = written(found.join(above.toDF("root", "top"), "root", "left").select("d1", "d2", F.coalesce("top", "root").alias("root"), "low"))
    for table in (classes, entries, pivots, tries, left, cells, pairs, large):
        discard(table)
    return labels


def keyed(docs: DataFrame, text_col: str, k: int, names: list[str]) -> DataFrame:
    """The documents, with all their columns, and the digest of their set in two columns, its size and the text's hash, named so.

    A text without words has a hash of the row in place of a digest.
    """
    keep, own = len(docs.columns), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts, place = batch.column(own).cast(pa.binary()), batch.column(keep).to_numpy()
            sets = shingle_sets(texts, k)
            size, d = np.array([len(s) for s in sets], np.int64), _digests(sets)
            cols = [np.where(size > 0, d[:, 0], place), np.where(size > 0, d[:, 1], 0), size, np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts.to_pylist()], np.uint64).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(c, pa.int64()) for c in cols)], [*batch.schema.names[:keep], *names])

    rows = docs.select("*", F.xxhash64(*[F.col(c) for c, t in docs.dtypes if "map" not in t and c != text_col], F.lit(0)).alias(names[0]))
    return rows.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names)]))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    classes = labelled_classes(docs, k, percent, heavy)
    lowest = classes.groupBy("root").agg(F.min("low").alias("lowest"))
    names = classes.join(lowest, "root").select("d1", "d2", "lowest")
    rows = keyed(docs, "text", k, ["d1", "d2", "n", "h"]).select("doc_id", "d1", "d2", "n")
    joined = rows.join(names, ["d1", "d2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """The documents, with all their columns, less all but one of each component.

    The row with the lowest id stays (one without an id only if none has one); of several texts under that id, the one with the lowest
    digest and hash; of rows that repeat id and text, one. Texts without words all stay.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    classes = labelled_classes(plain, k, percent, heavy)
    used, names = {c.lower() for c in docs.columns}, []
    for name in ("d1", "d2", "n", "h", "i", "copy", "k1", "k2", "k3", "k4"):
        while name in used:
            name += "_"
        names.append(name)
        used.add(name)
    d1, d2, n, h, i, copy, k1, k2, k3, k4 = names
    rows = keyed(docs, text_col, k, [d1, d2, n, h]).withColumn(i, F.col(id_col).cast("long"))
    low = keyed(plain, "text", k, ["d1", "d2", "n", "h"]).where("n > 0").groupBy("d1", "d2", "doc_id", "h").agg(F.count("*").alias("copies"))
    low = low.join(classes.select("d1", "d2", "root"), ["d1", "d2"]).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2", "h", "copies")).alias("r"))
    low = written(low.select(*(F.col(f"r.{c}").alias(x) for c, x in (("d1", k1), ("d2", k2), ("doc_id", k3), ("h", k4), ("copies", copy)))))
    match = (F.col(d1) == F.col(k1)) & (F.col(d2) == F.col(k2)) & (F.col(h) == F.col(k4)) & F.col(i).eqNullSafe(F.col(k3))
    stay = rows.join(low.where(F.col(copy) == 1), match, "left").where((F.col(n) == 0) | F.col(k1).isNotNull()).select(docs.columns)
    repeated = low.where(F.col(copy) > 1)
    if repeated.isEmpty():
        return stay
    return stay.union(rows.join(repeated, match, "left_semi").dropDuplicates([d1, d2, h, i]).select(docs.columns))
