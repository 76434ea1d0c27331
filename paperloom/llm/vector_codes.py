"""Product codes of vectors: integer codebooks trained on all rows, nearest entries found through a VA-file.

Each component x becomes the integer floor(4096 x). A vector is cut into ``PARTS`` equal parts, each with a codebook of ``ENTRIES`` entries; a
round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to its parts'
floored mean.

The nearest entry is found as a VA-file does: the entries' coordinates are quantised to ``BITS`` bits, cells of a grid between each coordinate's least
and greatest. For each vector, a lookup table by coordinate and cell has the least and the greatest squared distance to
any point of the cell; sums over a part's coordinates bound the distance to each entry from below and above. Only entries whose lower bound isn't over the least upper
bound are refined, by exact integer distances, so the filter changes no result.

Each round is one narrow pass in Arrow batches: a task sends its sums and counts (``PARTS`` x ``ENTRIES`` rows of a part's length, whatever the number of vectors),
map-side summed again by the engine; the driver sees one sum for each coordinate of the codebooks. A lost executor costs its tasks of one round only. Nothing depends on a group: one vector or label may be all rows.

Rows that are dropped: null vectors, and those with a null or non-finite component. Vectors whose length isn't that of the lowest kept ``vec_id`` can't be
measured: they stay, with null ``code`` and ``error``. A length that isn't a multiple of ``PARTS`` is filled with zeros. The first entries are those of the lowest
distinct ids (of rows that repeat an id, the least vector); with fewer ids, codebooks are shorter. Null ids: coded as others, never first entries, unless no row has an id: then there is no codebook and codes are null.
Repeated rows: a row each, and each counts in the means. Components of any finite size are exact (beyond 2^24 in Python integers); errors beyond a long are the
greatest long. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, written

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 4096, 8, 16, 6, 3
#: Integers under this are computed with in 64 bits, and wider ones in limbs of as many bits.
LIMB = 24
#: Vectors whose tables a worker makes at once.
ROWS = 1024
LONGEST = (1 << 63) - 1

SCHEMA = "vec_id long, label int, code string, error long"


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: as 64-bit integers, or as Python integers if one is wide."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < 1 << LIMB:
        return scaled.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(np.floor(values.astype(np.longdouble) * SCALE) if np.isinf(scaled).any() else scaled)


def integers(values: list | np.ndarray) -> np.ndarray:
    """An array of Python integers, in 64 bits if all are narrow."""
    wide = np.array(values, dtype=object)
    return wide.astype(np.int64) if all(abs(x) < 1 << LIMB for x in wide.flat) else wide


class Codebooks:
    """Entries as integers by (part, entry, position), and their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        parts, n, width = entries.shape
        points = entries.transpose(1, 0, 2).reshape(n, parts * width)
        low, high = points.min(0), points.max(0)
        edges = np.stack([low + (high - low + 1) * k // (1 << bits) for k in range((1 << bits) + 1)], 1)
        #: The cell of each entry's coordinate, and each cell's least and greatest integer.
        self.cell = np.stack([(points[:, j, None] >= edges[j, 1:-1]).sum(1) for j in range(parts * width)], 1).astype(np.int64) if parts * width else np.zeros((n, 0), np.int64)
        self.low, self.high = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        self.most = int(max((abs(x) for x in points.flat), default=0)) + 1

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the distance of each vector's part to each entry, through tables by coordinate and cell."""
        parts, n, width = self.entries.shape
        low, high = self.low, self.high
        if vectors.dtype == np.int64 and len(vectors) and width * (self.most + int(np.abs(vectors).max()) + 1) ** 2 < 1 << 31:
            low, high, vectors = low.astype(np.int32), high.astype(np.int32), vectors.astype(np.int32)  # no sum leaves 32 bits
        below, above = low - vectors[:, :, None], vectors[:, :, None] - high
        inside = np.maximum(np.maximum(below, above), 0)
        least = inside * inside
        far = np.maximum(np.abs(below), np.abs(above))
        most = far * far
        cells = least.shape[2]
        at = (np.arange(parts * width) * cells + self.cell).reshape(-1)  # of each entry's coordinates in a vector's table
        shape = (len(vectors), n, parts, width)
        lower, upper = (table.reshape(len(vectors), -1).take(at, 1).reshape(shape).sum(3, dtype=table.dtype).transpose(0, 2, 1) for table in (least, most))
        return lower, upper

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry of each part, its distance, distances that were refined) of vectors of integers."""
        parts, n, width = self.entries.shape
        if vectors.dtype != self.entries.dtype:
            vectors = vectors.astype(object)
        lower, upper = self.bounds(vectors)
        row, part, entry = np.nonzero(lower <= upper.min(2)[:, :, None])
        gap = vectors.reshape(len(vectors), parts, width)[row, part] - self.entries[part, entry]
        exact = np.full((len(vectors), parts, n), LONGEST, object if gap.dtype == object else np.int64)
        if gap.dtype == object:
            exact[:] = (1 << 600) - 1
        exact[row, part, entry] = (gap * gap).sum(1)
        code = exact.argmin(2)
        return code, np.take_along_axis(exact, code[:, :, None], 2)[:, :, 0], len(row)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def sound(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): rows whose vector has no null, NaN or infinite component."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), v.cast("array<double>").alias("v"))


def first_entries(kept: DataFrame, parts: int, entries: int) -> tuple[np.ndarray | None, int]:
    """(codebooks before the first round, length of vectors): parts of the lowest ids' vectors; none if no row has an id."""
    ids = kept.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = ids.orderBy("vec_id").limit(entries).collect()
    if not rows:
        return None, -1
    width = len(rows[0].v)
    points = [padded(whole(np.array([r.v])), parts)[0] for r in rows if len(r.v) == width]
    return integers(np.stack(points).reshape(len(points), parts, -1).transpose(1, 0, 2).astype(object)), width


def padded(vectors: np.ndarray, parts: int) -> np.ndarray:
    more = -vectors.shape[1] % parts
    return np.pad(vectors, ((0, 0), (0, more))) if more else vectors


def _blocks(batch: pa.RecordBatch, width: int, parts: int):
    """(rows of the batch, their integers) of the vectors that have the codebooks' length; narrow and wide ones apart."""
    lists = batch.column(batch.num_columns - 1)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
    wide = (np.abs(values) * SCALE >= (1 << LIMB) - 1).any(1) if width else np.zeros(len(rows), bool)
    for some in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(some):
            yield rows[some], padded(whole(values[some]), parts)


def moved(kept: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    parts, n, each = books.entries.shape

    def limbs(x: int):
        """(limb number, limb) of a wide integer, with its sign on each."""
        sign, x, k = (-1 if x < 0 else 1), abs(x), 0
        while x:
            yield k, sign * (x & ((1 << LIMB) - 1))
            x, k = x >> LIMB, k + 1

    def run(batches):
        sums, counts, wide = np.zeros((parts * n, each), np.int64), np.zeros(parts * n, np.int64), {}
        for batch in slices(batches, ROWS):
            for _, vectors in _blocks(batch, width, parts):
                code, _, _ = books.nearest(vectors)
                slot = code + np.arange(parts) * n
                counts += np.bincount(slot.reshape(-1), minlength=parts * n)
                pieces = vectors.reshape(len(vectors), parts, each)
                if vectors.dtype == object:
                    for r, p, j in np.ndindex(pieces.shape):
                        for k, x in limbs(int(pieces[r, p, j])):
                            wide[slot[r, p], j, k] = wide.get((slot[r, p], j, k), 0) + x
                else:
                    for j in range(each):
                        np.add.at(sums[:, j], slot, pieces[:, :, j])
        used = np.flatnonzero(counts)
        rows = [(int(s), -1, 0, int(counts[s])) for s in used] + [(int(s), j, 0, int(sums[s, j])) for s in used for j in range(each)] + [(int(s), j, k, x) for (s, j, k), x in wide.items()]
        for low in range(0, len(rows), 1 << 14):
            columns = list(zip(*rows[low : low + (1 << 14)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "j", "limb", "x"])

    totals = kept.select("v").mapInArrow(run, "slot long, j long, limb long, x long").groupBy("slot", "j", "limb").agg(F.sum("x").alias("x")).collect()
    counts, sums = {r.slot: r.x for r in totals if r.j < 0}, {}
    for r in totals:
        if r.j >= 0:
            sums[r.slot, r.j] = sums.get((r.slot, r.j), 0) + (r.x << (LIMB * r.limb))
    entries = books.entries.astype(object)
    for slot, count in counts.items():
        for j in range(each):
            entries[slot // n, slot % n, j] = sums.get((slot, j), 0) // count
    return Codebooks(integers(entries))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks | None, int]:
    """(codebooks, length of the vectors that they are for) after all rounds, each over all rows."""
    first, width = first_entries(kept, parts, entries)
    if first is None:
        return None, width
    books = Codebooks(first)
    for _ in range(rounds):
        books = moved(kept, books, width)
    return books, width


def assigned(kept: DataFrame, books: Codebooks | None, width: int) -> DataFrame:
    """(vec_id, label, code, error) of each row: the nearest entry of each part as two hex digits, and the distances' sum."""

    def run(batches):
        for batch in slices(batches, ROWS):
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for rows, vectors in _blocks(batch, width, books.entries.shape[0]) if books else ():
                code, distance, _ = books.nearest(vectors)
                joined = code.astype(np.uint8).tobytes().hex()
                step = 2 * code.shape[1]
                codes[rows] = [joined[at : at + step] for at in range(0, len(joined), step)]
                errors[rows] = [min(int(x), LONGEST) for x in distance.sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, SCHEMA)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over equal labels, nulls together) and the codebooks' digest."""
    kept = sound(vectors, id_col, vector_col, label_col)
    books, width = train(kept, parts, entries, rounds)
    coded = written(assigned(kept, books, width))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_of")
    digest = books.digest() if books else None
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_of"))).drop("_of").withColumn("codebooks_sha256", F.lit(digest).cast("string"))
