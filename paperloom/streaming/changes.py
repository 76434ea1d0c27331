"""Change feeds on Structured Streaming: keyed state, and classified changes.

State lives in a Parquet snapshot that ``foreachBatch`` merges batch by batch; a batch writes a new
version under its id and moves the pointer after that, so a batch that is replayed after a failure
yields the same version. Work downstream runs only for batches with new or modified rows, and the state
is saved after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import detect_changes, last_of_each
from ..operators.scans import coalesced, undone
from ..sources import log


class Snapshots:
    """Versions of a keyed table in a folder; version -1 is empty."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(version))


def merge_batch(snapshots: Snapshots, batch: DataFrame, version: int, key: str, mark: str, order: str, on_change: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Merges a batch's last row of each key into the snapshot; returns (key, change) of the batch."""
    known = snapshots.read(version - 1)
    latest = last_of_each(batch, key, F.col(order)).select(known.columns)
    changes = detect_changes(known.join(latest.select(key), key, "left_semi"), latest, key, mark)
    if on_change is not None:
        fresh = changes.where("change in ('new', 'modified')")
        if not fresh.isEmpty():
            on_change(latest.join(fresh, key))
    known.join(latest, key, "left_anti").unionByName(latest).write.mode("overwrite").parquet(snapshots.path(version))
    return changes


def watch(stream: DataFrame, snapshots: Snapshots, key: str, mark: str, order: str, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, every: str | None = None):
    """A streaming query that keeps the snapshot up to date; ``every`` is a processing time, else all that is there now."""

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_batch(snapshots, batch, batch_id, key, mark, order, on_change)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def commit_edits(edits: DataFrame, stream: str, order: list[str], signature: list[str], old: str, new: str, is_undo: str, path: str, transaction: str) -> None:
    """Staged edits as one transaction of an append log: those that undos left, each run of one signature as a single edit. Committed again under the same name, nothing is added."""
    left = undone(edits, stream, order, is_undo)
    log.append(coalesced(left, stream, order, signature, old, new), path, transaction)
