"""Keyed state in the state store: changes, deletions by timer, restart from the checkpoint, bytes written by a batch."""

import os
import time

import pytest

from paperloom.streaming import keyed as K

SCHEMA = "path string, md5 string, at long"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, checkpoint, seen=None, **more):
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    K.watch(stream, "path", "md5", "at", str(checkpoint), on_change=(lambda d, i: seen.extend(map(tuple, d.select("key", "change", "mark").collect()))) if seen is not None else None, **more).awaitTermination()


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def test_changes_and_a_restart(spark, tmp_path):
    data, checkpoint, seen = tmp_path / "data", tmp_path / "log", []
    put(spark, data, [("a", "1", 10), ("b", "1", 11), ("a", "2", 12), (None, "x", 1), ("c", None, 3)])
    run(spark, data, checkpoint, seen)
    assert sorted(seen, key=str) == [("a", "new", "2"), ("b", "new", "1"), ("c", "new", None)]
    seen.clear()
    put(spark, data, [("a", "2", 20), ("b", "9", 21), ("d", "1", 22), ("a", "old", 5)])
    run(spark, data, checkpoint, seen)  # a new query on the same checkpoint
    assert sorted(seen) == [("b", "modified", "9"), ("d", "new", "1")]
    assert sorted(map(tuple, K.state(spark, str(checkpoint)).collect())) == [("a", "2", 5, 20), ("b", "9", 11, 21), ("c", None, 3, 3), ("d", "1", 22, 22)]


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    data, checkpoint = tmp_path / "data", tmp_path / "log"
    put(spark, data, [(f"p{i}", f"{i:064d}", i) for i in range(20000)])
    run(spark, data, checkpoint)
    whole = size(checkpoint / "state")
    put(spark, data, [("p1", "changed", 10**6)])
    run(spark, data, checkpoint)
    assert size(checkpoint / "state") - whole < whole / 10


def test_a_key_that_is_not_seen_is_deleted(spark, tmp_path):
    data, checkpoint, out = tmp_path / "data", tmp_path / "log", []
    put(spark, data, [("a", "1", 1), ("b", "1", 2)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(data))
    with K.store(spark):
        q = K.changes(stream, "path", "md5", "at", absent_ms=1).writeStream.outputMode("update").foreachBatch(lambda d, i: out.extend(map(tuple, d.select("key", "change").collect()))).option("checkpointLocation", str(checkpoint)).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and sum(c == "deleted" for _, c in out) < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(out) == [("a", "deleted"), ("a", "new"), ("b", "deleted"), ("b", "new")]


def test_settings_are_put_back(spark):
    with pytest.raises(ValueError), K.store(spark):
        raise ValueError
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", None) != "true"
