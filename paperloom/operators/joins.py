"""Lookups, change detection, upserts, tiered matching, closure and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import checkpointed


def detect_changes(known: DataFrame, found: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change): new, modified, deleted or unchanged, by a full outer join on the key."""
    k = known.select(key, F.col(mark).alias("_old"), F.lit(True).alias("_k"))
    f = found.select(key, F.col(mark).alias("_new"), F.lit(True).alias("_f"))
    both = k.join(f, key, "full_outer")
    change = F.when(F.col("_k").isNull(), "new").when(F.col("_f").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def last_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key; folds on the map side."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Stored rows, replaced by the last new row of the same key; new keys are added."""
    latest = last_of_each(new, key, order).select(stored.columns)
    return stored.join(latest, key, "left_anti").unionByName(latest)


def merged_manifest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The old rows in their order, those of a name that the new rows have replaced by the last of them; then the other new rows' last ones, in the order of their names' first sight.

    Both have the same columns; ``place`` is (0, old order) or (1, order of first sight). Rows without a name are left out.
    """
    values = [c for c in old.columns if c not in (key, order)]
    pack = F.struct(*values)
    latest = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(pack, order).alias("_new"), F.min(order).alias("_first"))
    rows = old.where(F.col(key).isNotNull()).select(key, F.col(order).alias("_at"), pack.alias("_old"))
    kept = rows.join(latest, key, "left").select(key, F.coalesce("_new", "_old").alias("_r"), F.struct(F.lit(0).alias("part"), F.col("_at").alias("at")).alias("place"))
    added = latest.join(rows, key, "left_anti").select(key, F.col("_new").alias("_r"), F.struct(F.lit(1).alias("part"), F.col("_first").alias("at")).alias("place"))
    return kept.unionByName(added).select(key, "_r.*", "place")


def unique_texts(rows: DataFrame, text: str, order: Column, letters: str) -> DataFrame:
    """(text, first_seen): the distinct texts with one of some letters (a pattern), and where they are first seen, which is their order."""
    return rows.where(F.col(text).rlike(letters)).groupBy(text).agg(F.min(order).alias("first_seen"))


def unique_matches(left: DataFrame, right: DataFrame, key: str, other: str, on: str) -> DataFrame:
    """(key, other) for values of ``on`` that exactly one row on the right has."""
    single = right.groupBy(on).agg(F.count("*").alias("_n"), F.min(other).alias(other)).where("_n = 1").drop("_n")
    return left.where(F.col(on).isNotNull()).join(single, on).select(key, other)


def first_tier(left: DataFrame, key: str, tiers: list[DataFrame], other: str) -> DataFrame:
    """(key, other, tier): the match of the first tier that has one; null and 0 without any."""
    tagged = None
    for n, rows in enumerate(tiers, 1):
        part = rows.select(key, other, F.lit(n).alias("tier"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(key).agg(F.min(F.struct("tier", other)).alias("_b"))
    return left.select(key).join(best, key, "left").select(key, F.col(f"_b.{other}").alias(other), F.coalesce("_b.tier", F.lit(0)).alias("tier"))


def closure(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """All nodes that the start nodes reach: a breadth-first search whose frontier is joined to the edges.

    Each round is written to the checkpoint folder, so lineage stays short and a lost executor costs one round.
    """
    seen = start.select(F.col(node).alias(node)).distinct()
    frontier = seen
    while True:
        step = frontier.join(edges, frontier[node] == edges[src]).select(edges[dst].alias(node)).distinct().join(seen, node, "left_anti")
        step = checkpointed(step)
        if step.isEmpty():
            return seen
        seen, frontier = seen.union(step), step


def bucket_range_join(points: DataFrame, boxes: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs where low <= x <= high: both sides are cut into buckets of ``width`` and joined on the bucket."""
    p = points.withColumn("_b", F.floor(F.col(x) / width))
    b = boxes.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(b, "_b").where(F.col(x).between(F.col(low), F.col(high))).drop("_b")
