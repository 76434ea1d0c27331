"""The folder that driver and executors share, for state that outlives a job."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one that was set as the checkpoint folder.

    Where neither is set one is made only if driver and executors are a single process (master ``local``); on a cluster, what one machine
    writes to its own folder another can't see, and this raises.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="loom-")
        atexit.register(shutil.rmtree, made, True)
        found = "file://" + made
    if not current.isDefined():
        sc.setCheckpointDir(found)
        # checkpoints go to a folder of this application's own
        deleted_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return found


def deleted_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which the driver deletes when it ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and cuts its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, whose size the planner knows; it stays until the driver ends."""
    spark = df.sparkSession
    path = deleted_at_exit(spark, f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
