"""A transactional log of JSON lines in a folder, as a data source for batches and streams.

Tasks write parts under names of their own attempt; nothing reads them until the driver publishes a *manifest* that lists the parts of the attempts that succeeded, by
one rename. So a killed task, a failed job or a lost driver leaves parts that no manifest names, and no lines. A manifest is named by its transaction:
one that is there already (a batch that is replayed after a failure) is not published again, and its new parts are deleted. A transaction that replaces
hides all before it: readers see all of the old lines or all of the new ones.

Folders are those of ``pyarrow.fs`` (local, HDFS, object stores): driver and executors must see the same one.
"""

from __future__ import annotations

import base64
import datetime
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

FORMAT = "loomlog"
PARTS, MANIFESTS = "parts", "manifests"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


@dataclass
class Part(WriterCommitMessage):
    name: str
    lines: int


class _Writer:
    def __init__(self, path: str, transaction: str, replaces: bool):
        self.path, self.transaction, self.replaces = path, transaction, replaces

    def write(self, iterator: Iterator[Row]) -> Part:
        rows = iter(iterator)
        first = next(rows, None)
        if first is None:
            return Part("", 0)
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{PARTS}")
        name, lines = f"{self.transaction}-{uuid.uuid4().hex}.json", 0
        with fs.open_output_stream(f"{root}/{PARTS}/{name}") as out:
            for row in itertools.chain([first], rows):
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=_plain) + "\n").encode())
                lines += 1
        return Part(name, lines)

    def _publish(self, parts: list[Part | None], transaction: str) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{MANIFESTS}")
        there = [f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}")) if f.base_name.endswith(".json")]
        if any(name.split("-", 1)[1] == f"{transaction}.json" for name in there):
            self._delete(parts)  # it was published before
            return
        number = 1 + max((int(name.split("-", 1)[0]) for name in there), default=-1)
        staged = f"{root}/{MANIFESTS}/{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(staged) as out:
            out.write(json.dumps({"transaction": transaction, "replaces": self.replaces, "parts": [p.name for p in parts if p and p.lines], "lines": sum(p.lines for p in parts if p)}).encode())
        fs.move(staged, f"{root}/{MANIFESTS}/{number:09d}-{transaction}.json")

    def _delete(self, parts: list[Part | None]) -> None:
        fs, root = _opened(self.path)
        for p in parts:
            if p and p.lines:
                fs.delete_file(f"{root}/{PARTS}/{p.name}")


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages) -> None:
        self._publish(messages, self.transaction)

    def abort(self, messages) -> None:
        self._delete(messages)


class StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self._publish(messages, f"{self.transaction}.{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self._delete(messages)


class Log(DataSource):
    """``format("loomlog")`` with the options ``path``, and ``transaction``: a name; for a stream that of the query, to which the batch's number is added."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _named(self, required: bool) -> str:
        found = self.options.get("transaction") or ("" if required else uuid.uuid4().hex)
        if not found or "/" in found:
            raise ValueError("a stream needs the option transaction, a name without slashes that stays the same when it is started again")
        return found

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self.options["path"], self._named(False), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self.options["path"], self._named(True), overwrite)


def append(df: DataFrame, path: str, transaction: str | None = None, replace: bool = False) -> None:
    """Adds the rows of a table as one transaction, or replaces all lines by them. A transaction that is there already adds nothing."""
    df.sparkSession.dataSource.register(Log)
    writer = df.write.format(FORMAT).mode("overwrite" if replace else "append").option("path", path)
    (writer.option("transaction", transaction) if transaction else writer).save()


def append_stream(df: DataFrame, path: str, query: str, checkpoint: str, every: str | None = None):
    """A streaming query that adds each batch as one transaction."""
    df.sparkSession.dataSource.register(Log)
    writer = df.writeStream.format(FORMAT).option("path", path).option("transaction", query).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def manifests(path: str) -> list[dict]:
    """What is published, in order, from the last transaction on that replaced all before it."""
    fs, root = _opened(path)
    found = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)) if f.base_name.endswith(".json")]
    out: list[dict] = []
    for f in sorted(found, key=lambda f: f.base_name):
        with fs.open_input_stream(f.path) as lines:
            entry = json.loads(lines.read())
        out = [entry] if entry["replaces"] else [*out, entry]
    return out


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The published lines as a table."""
    parts = [f"{path}/{PARTS}/{name}" for m in manifests(path) for name in m["parts"]]
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)


def abandoned(path: str) -> list[str]:
    """Parts that no manifest names, of any transaction that is not running now; for an operator to delete."""
    fs, root = _opened(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    named: set[str] = set()
    for f in found:
        if f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path) as lines:
                named |= set(json.loads(lines.read())["parts"])
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/{PARTS}", allow_not_found=True)) if f.base_name not in named)
