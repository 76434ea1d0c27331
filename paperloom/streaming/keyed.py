"""Keyed state of a change feed in the engine's state store: a value for each key, a timer for keys that are no longer seen.

``transformWithState`` keeps each key's mark, first sight and last row in RocksDB with a changelog, so a batch writes as much as the keys that it touches,
never the whole state, and a restart goes on from the checkpoint. Change rows come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Session settings of such a query: state in RocksDB, of which a batch writes the changes only.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
CHANGES = "key string, change string, mark string, first_seen long, last_seen long"
_STATE = "mark string, first_seen long, last_seen long, due long"


class Seen(StatefulProcessor):
    """Rows (key, mark, at) of one key: new, modified or unchanged by the mark of the last row by ``at``; deleted when nothing came for ``absent_ms``."""

    def __init__(self, absent_ms: int | None = None):
        self.absent_ms = absent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, mark = None, None, None
        for r in rows:  # equal times are settled by the mark
            first = r.at if first is None else min(first, r.at)
            if last is None or (r.at, r.mark or "") > (last, mark or ""):
                last, mark = r.at, r.mark
        before = self.known.get() if self.known.exists() else None
        if before is not None and before[2] > last:  # late rows change nothing
            last, mark = before[2], before[0]
        change = "new" if before is None else "unchanged" if before[0] == mark else "modified"
        due = None
        if self.absent_ms is not None:
            if before is not None and before[3] is not None:
                self.handle.deleteTimer(before[3])
            due = timerValues.getCurrentProcessingTimeInMs() + self.absent_ms
            self.handle.registerTimer(due)
        seen = first if before is None else min(first, before[1])
        self.known.update((mark, seen, last, due))
        yield Row(key=key[0], change=change, mark=mark, first_seen=seen, last_seen=last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.known.exists():
            mark, first, last, _ = self.known.get()
            self.known.clear()
            yield Row(key=key[0], change="deleted", mark=mark, first_seen=first, last_seen=last)

    def close(self) -> None:
        pass


@contextmanager
def store(spark: SparkSession):
    """Within it, streaming queries that are started keep their state as :data:`STORE` says."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changes(stream: DataFrame, key: str, mark: str, order: str, absent_ms: int | None = None) -> DataFrame:
    """Change rows of a stream: (key, change, mark, first_seen, last_seen) for each key of a batch, and deletions. Keys and marks are strings, the order a long; rows without a key are left out."""
    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(mark).cast("string").alias("mark"), F.col(order).cast("long").alias("at"))
    timers = "None" if absent_ms is None else "ProcessingTime"
    return rows.groupBy("key").transformWithState(statefulProcessor=Seen(absent_ms), outputStructType=CHANGES, outputMode="Update", timeMode=timers)


def watch(stream: DataFrame, key: str, mark: str, order: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, absent_ms: int | None = None, every: str | None = None):
    """A streaming query over :func:`changes`; ``on_change`` gets a batch's new and modified rows, if there are any, before the batch counts as done."""

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where("change in ('new', 'modified')")
        if on_change is None:
            batch.write.format("noop").mode("overwrite").save()
            return
        kept = fresh.persist()  # the state is read once, however often the rows are
        try:
            if not kept.isEmpty():
                on_change(kept, batch_id)
        finally:
            kept.unpersist()

    with store(stream.sparkSession):
        writer = changes(stream, key, mark, order, absent_ms).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, mark, first_seen, last_seen): the state that a query's checkpoint holds, read by the engine's own reader."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "known").load()
    return found.select("key.key", "value.mark", "value.first_seen", "value.last_seen")
