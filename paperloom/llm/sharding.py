"""Sharding by histogram sort: shards of near-equal bytes, from exact counts below probed boundaries.

Rows are ordered by the key (64-bit hash of the text, hash of the id), so equal texts, a *group*, stand together. Groups of over
``LARGE`` of a shard's bytes that fit in a shard are so few (``shards`` / ``LARGE`` at most) that the driver deals them out, the
largest first, each to the shard with the fewest bytes. The other rows of the 40 shards are ranges of the key's order that fill each up to its equal share.
Their boundaries (splitters) are found without sorting: in each
round the exact bytes and rows of the bins between candidate boundaries are counted across all
partitions, with map-side sums; for each splitter, the bin that its target falls into is probed again
by finer boundaries, until a boundary's exact bytes below are within tolerance of the target or a bin
holds one group only. The key's digits are the probes. A group that fits in a shard is never split; one that doesn't is refined
through the hashes of its ids and split where the target falls. Then rows move once, each straight to its place.

Shards differ from each other by ``LARGE`` of a shard at most, the size of the groups at their two ends, unless single groups or rows leave no
choice: a row that is larger than a shard's share, or groups of over half of it, which no dealing makes equal.

A shard isn't one task: its rows are dealt on by the first bits of their hash into *bins*, of as many bytes as a task takes at once whatever the
size of the table, and those of groups over that by hashes of ids. A row's slot is its rank in its bin plus the rows of the shard's bins before it; slots have no gaps.

DataFrame functions only. The driver sees bins' sums, at most 2^FIRST_BITS, then 2^NEXT_BITS for each
splitter, and the large groups. Null text: as empty. Null, negative and wide ids: by their hashes. Very long texts: a row each, whole. Rows that repeat id and text
are one key: they stay in one shard. Ties: equal keys in any order. Empty table: no rows. The columns ``shard`` and ``slot`` of the input, if any, are replaced; others may have any names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed, written

SHARDS = 40
#: A splitter is near enough when its error is under this share of a shard's bytes.
TOLERANCE = 0.001
#: Groups over this share of a shard's bytes are dealt out one by one.
LARGE = 0.01
#: Bytes that a task ranks at once, and bins that there are at least.
BIN_BYTES, BINS = 64 << 20, 512
FIRST_BITS, NEXT_BITS = 14, 9
HASH_BITS = 63
OVERHEAD = 16
_H, _D, _SHARD, _BIN, _SUB, _RANK, _BASE = "_shard_hash", "_shard_id", "_shard_of", "_shard_bin", "_shard_sub", "_shard_rank", "_shard_base"


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus a row's overhead."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + OVERHEAD


@dataclass
class Splitter:
    """Rows under (hash, id) are below: exactly so many bytes and rows."""

    hash: int
    id: int
    bytes: int
    rows: int


def _digits() -> list[tuple[str, int, int]]:
    """(column, shift, bits) of the key's digits, most significant first."""
    out, left = [("h", HASH_BITS - FIRST_BITS, FIRST_BITS)], HASH_BITS - FIRST_BITS
    while left:
        bits = min(NEXT_BITS, left)
        left -= bits
        out.append(("h", left, bits))
    left = HASH_BITS
    while left:
        bits = min(NEXT_BITS, left)
        left -= bits
        out.append(("d", left, bits))
    return out


def splitters(keys: DataFrame, targets: list[int], tolerance: float, whole: float) -> list[Splitter]:
    """The splitters for the targets, by rounds of counting. keys: (h, d, size). Groups of up to ``whole`` bytes aren't split."""
    digits = _digits()
    found: dict[int, Splitter] = {}
    active: dict[tuple[int, int], tuple[int, int, list[int]]] = {}  # prefix (h, d) -> bytes and rows before it, targets inside
    for level, (column, shift, bits) in enumerate(digits):
        rows = keys
        if level:
            if not active:
                break
            above = digits[level - 1]
            # earlier digits of the rows that are still of interest; prefixes are as many as splitters at most
            if column == "d" and above[0] == "h":
                rows = rows.where(F.col("h").isin([h for h, _ in active])).withColumn("ph", F.col("h")).withColumn("pd", F.lit(0).cast("long"))
            elif column == "h":
                rows = rows.withColumn("ph", F.shiftright("h", above[1])).withColumn("pd", F.lit(0).cast("long")).where(F.col("ph").isin([h for h, _ in active]))
            else:
                rows = rows.withColumn("ph", F.col("h")).withColumn("pd", F.shiftright("d", above[1]))
                rows = rows.where(F.struct("ph", "pd").isin([F.struct(F.lit(h).cast("long"), F.lit(d).cast("long")) for h, d in active]))
        else:
            rows = rows.withColumn("ph", F.lit(0).cast("long")).withColumn("pd", F.lit(0).cast("long"))
        digit = F.shiftright(column, shift).bitwiseAND(F.lit((1 << bits) - 1)).alias("digit")
        bins = rows.groupBy("ph", "pd", digit).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        if not level:
            active = {(0, 0): (0, 0, list(range(len(targets))))}
        last = level == len(digits) - 1
        deeper: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
        by_prefix: dict[tuple[int, int], list] = {}
        for r in bins:
            by_prefix.setdefault((r.ph, r.pd), []).append(r)
        for prefix, (low_bytes, low_rows, inside) in active.items():
            edges = sorted(by_prefix.get(prefix, []), key=lambda r: r.digit)
            at_bytes, at_rows, waiting = low_bytes, low_rows, sorted(inside, key=lambda t: targets[t])
            for r in edges:
                while waiting and targets[waiting[0]] <= at_bytes + r.bytes:
                    t = waiting.pop(0)
                    below, above_ = targets[t] - at_bytes, at_bytes + r.bytes - targets[t]
                    group = column == "h" and not shift and r.bytes <= whole
                    if last or min(below, above_) <= tolerance or r.rows == 1 or group:
                        step = 1 if above_ < below else 0
                        found[t] = _bound(column, prefix, (r.digit + step), shift, bits, at_bytes + step * r.bytes, at_rows + step * r.rows)
                    else:
                        head = (prefix[0] << bits | r.digit, 0) if column == "h" else (prefix[0], prefix[1] << bits | r.digit)
                        deeper.setdefault(head, (at_bytes, at_rows, []))[2].append(t)
                at_bytes, at_rows = at_bytes + r.bytes, at_rows + r.rows
            for t in waiting:  # a target at the very end
                found[t] = Splitter((1 << HASH_BITS) - 1, (1 << 63) - 1, at_bytes, at_rows)
        active = deeper
    return [found[t] for t in sorted(found)]


def _bound(column: str, prefix: tuple[int, int], digit: int, shift: int, bits: int, below: int, rows: int) -> Splitter:
    if column == "h":
        h = (prefix[0] << bits) + digit << shift
        return Splitter(min(h, (1 << HASH_BITS) - 1), 0 if h < 1 << HASH_BITS else (1 << 63) - 1, below, rows)
    return Splitter(prefix[0], min((prefix[1] << bits) + digit << shift, (1 << 63) - 1), below, rows)


def _place(bounds: list[Splitter], low: int, high: int) -> Column:
    """The number of splitters at or below a row's key: a balanced tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    b = bounds[middle]
    below = (F.col(_H) < F.lit(b.hash)) | ((F.col(_H) == F.lit(b.hash)) & (F.col(_D) < F.lit(b.id)))
    return F.when(below, _place(bounds, low, middle)).otherwise(_place(bounds, middle + 1, high))


def dealt(groups: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """(hash -> shard, bytes of each shard): the largest group first, each to the emptiest shard."""
    heap = [(0, k) for k in range(shards)]
    at = {}
    for size, h in sorted(((b, h) for h, b in groups), reverse=True):
        have, k = heapq.heappop(heap)
        at[h] = k
        heapq.heappush(heap, (have + size, k))
    sizes = [0] * shards
    for have, k in heap:
        sizes[k] = have
    return at, sizes


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, bins: int = BINS) -> DataFrame:
    """The documents, with all their columns, and ``shard`` and ``slot``."""
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 1)
    d = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long")), 1)
    keys = checkpointed(docs.select(h.alias("h"), d.alias("d"), row_size(F.col(text_col)).alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = total / shards
    # at most shards / LARGE groups are so large
    groups = keys.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > LARGE * each).collect()
    at, sizes = dealt([(r.h, r.bytes) for r in groups if r.bytes <= each], shards)
    rest = [max(0.0, each - x) for x in sizes]
    bits = max(bins, -(-total // BIN_BYTES)).bit_length() - 1
    # h:shard:bits of its ids' hashes that deal a group on
    named = [f"{r.h}:{at.get(r.h, -1)}:{min(30, max(0, int(r.bytes * (1 << bits) // max(total, 1)).bit_length()))}" for r in groups]
    entry = F.split("entry", ":")
    large = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(",".join(named)), ",")).alias("entry"))
    large = large.where("entry != ''").select(entry[0].cast("long").alias(_H), entry[1].cast("int").alias("_shard_to"), entry[2].cast("int").alias("_shard_bits"))

    pool = keys.join(F.broadcast(large.where("_shard_to >= 0").withColumnRenamed(_H, "h")), "h", "left_anti")
    left = total - sum(sizes)
    share = left / sum(rest) if sum(rest) else 0.0
    targets = [int(share * sum(rest[:k])) for k in range(1, shards)]
    bounds = splitters(pool, targets, tolerance * each, each)
    bounds.sort(key=lambda b: (b.hash, b.id))

    placed = F.coalesce(F.when(F.col("_shard_to") >= 0, F.col("_shard_to")), _place(bounds, 0, len(bounds)))
    sub = F.coalesce(F.expr(f"shiftright({_D}, {HASH_BITS} - _shard_bits)"), F.lit(0).cast("long"))

    def binned(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(large), _H, "left").withColumns({_SHARD: placed, _BIN: F.shiftrightunsigned(_H, HASH_BITS - bits), _SUB: sub}).drop("_shard_to", "_shard_bits")

    # rows before each bin of a shard: a row for each bin
    place = [_SHARD, _BIN, _SUB]
    counted = written(binned(keys.select(F.col("h").alias(_H), F.col("d").alias(_D))).groupBy(place).agg(F.count("*").alias("n")))
    before = Window.partitionBy(_SHARD).orderBy(_BIN, _SUB).rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias(_BASE))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    # the table's own columns travel as one, so that none can have the name of another
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    rank = F.row_number().over(Window.partitionBy(place).orderBy(_H, _D))
    ranked = binned(docs.select(F.struct(*map(F.col, quoted)).alias("_shard_row"), h.alias(_H), d.alias(_D))).withColumn(_RANK, rank)
    return ranked.join(base, place).select("_shard_row.*", F.col(_SHARD).alias("shard"), (F.col(_RANK) - 1 + F.col(_BASE)).alias("slot"))
