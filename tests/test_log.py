"""The transactional log: killed tasks, failed jobs, replayed batches, replacements; and the sinks and sources around it."""

import io
import json
import os
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from paperloom.sources import files, indexes, log
from paperloom.streaming import changes

SCHEMA = "n long, t string"


def rows(spark, path):
    return sorted(map(tuple, log.read(spark, path, SCHEMA).collect()))


def test_transactions_are_added_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    df = spark.createDataFrame([(1, "a"), (2, "é\n")], SCHEMA).repartition(3)
    assert rows(spark, path) == []
    log.append(df, path, "first")
    log.append(df, path, "first")  # replayed
    assert rows(spark, path) == [(1, "a"), (2, "é\n")] and log.abandoned(path) == []
    log.append(df.limit(1), path)
    assert len(rows(spark, path)) == 3
    log.append(df.where("n = 2"), path, "new base", replace=True)
    assert rows(spark, path) == [(2, "é\n")]
    log.append(df.where("false"), path, "empty")
    assert len(rows(spark, path)) == 1 and len(log.manifests(path)) == 2


def test_a_failed_job_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"

    def fail(batches):
        for batch in batches:
            yield batch
            raise RuntimeError("lost")

    df = spark.range(40).select(F.col("id").alias("n"), F.lit("x").alias("t")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        log.append(df.mapInArrow(fail, SCHEMA), path, "t")
    assert rows(spark, path) == []
    log.append(df, path, "t")
    assert len(rows(spark, path)) == 40


def test_a_killed_task_leaves_a_part_that_nobody_reads(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    writer = log.BatchWriter(path, "t", False)
    from pyspark.sql import Row

    writer.write(iter([Row(n=1, t="lost")]))  # this attempt's message never arrives
    writer.commit([writer.write(iter([Row(n=1, t="again")])), None])
    assert rows(spark, path) == [(1, "again")] and len(log.abandoned(path)) == 1
    before = os.listdir(tmp_path / "log" / "parts")
    writer.commit([writer.write(iter([Row(n=1, t="replayed")]))])  # the transaction is there: its new part goes
    assert rows(spark, path) == [(1, "again")] and os.listdir(tmp_path / "log" / "parts") == before
    writer.abort([writer.write(iter([Row(n=2, t="x")])), None])
    assert os.listdir(tmp_path / "log" / "parts") == before


def test_a_stream_and_a_replayed_batch(spark, tmp_path):
    path, source = f"file://{tmp_path}/log", tmp_path / "in"
    put = lambda n: spark.createDataFrame([(n, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: log.append_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), path, "q", str(tmp_path / "check")).awaitTermination()
    put(1)
    run()
    put(2)
    run()
    assert rows(spark, path) == [(1, "x"), (2, "x")]
    for name in ("1", ".1.crc"):
        os.remove(tmp_path / "check" / "commits" / name)  # the driver is lost after publishing: the batch runs again
    run()
    assert rows(spark, path) == [(1, "x"), (2, "x")] and [m["transaction"] for m in log.manifests(path)] == ["q.0", "q.1"]


def test_replacement_of_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    d = spark.createDataFrame([("a", "#FFF #fff"), ("b", "x")], "name string, svg string")
    assert {tuple(r) for r in indexes.publish_replacement(d, "name", "svg", {"#fff": "#000"}, path, dry_run=True).collect()} == {("a", 2), ("b", 0)}
    assert log.manifests(path) == []
    log.append(d, path)
    indexes.publish_replacement(d, "name", "svg", {"#fff": "#000"}, path)
    assert {tuple(r) for r in log.read(spark, path, "name string, svg string").collect()} == {("a", "#000 #000"), ("b", "x")}


def test_committed_edits(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    edits = [("s", 1, "size", "1", "2", False), ("s", 2, "size", "2", "3", False), ("s", 3, "fill", "a", "b", False), ("s", 4, "", "", "", True), ("s", 5, "size", "3", "4", False)]
    df = spark.createDataFrame(edits, "s string, n int, k string, o string, v string, u boolean")
    for _ in range(2):
        changes.commit_edits(df, "s", ["n"], ["k"], "o", "v", "u", path, "commit 1")
    assert [tuple(r) for r in log.read(spark, path, "s string, k string, o string, v string, edits int").collect()] == [("s", "size", "1", "4", 3)]


def test_index_sinks_and_readers(spark, tmp_path):
    slides = spark.createDataFrame([("a.pptx", "A", 1, "one", ["x"]), ("a.pptx", "A", 2, "two", None), ("b.pptx", None, 1, "three", [])], "file string, title string, slide_num int, text string, keywords array<string>")
    indexes.write_slide_index(slides, str(tmp_path / "index"))
    back = indexes.slide_entries(indexes.read_slide_index(spark, str(tmp_path / "index"), lines=True))
    assert sorted(map(tuple, back.select("source_id", "title", "slide_num", "slide_count", "display_text", "keywords").collect()), key=str) == [("a.pptx::1", "A", 1, 2, "one", ["x"]), ("a.pptx::2", "A", 2, 2, "two", []), ("b.pptx::1", None, 1, 1, "three", [])]
    indexes.append_log(slides.select("file"), f"file://{tmp_path}/jobs", "t1")
    assert log.read(spark, f"file://{tmp_path}/jobs", "file string").count() == 3
    indexes.write_by_key(spark.createDataFrame([("n1", "note one"), ("n2", "note two")], "k string, v string"), "k", str(tmp_path / "notes"))
    assert spark.read.text(str(tmp_path / "notes")).where("k = 'n2'").first().value == "note two"
    indexes.write_report(slides.select("file", "slide_num"), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 3


def test_sources_fall_back(spark, tmp_path):
    some, none = spark.range(1), spark.range(0)
    assert files.first_non_empty(none, some, spark.range(5)).count() == 1 and files.first_non_empty(none, none).count() == 0
    (tmp_path / "x.json").write_text("{}")
    assert files.first_existing(spark, [f"file://{tmp_path}/no.json", f"file://{tmp_path}/x.json", f"file://{tmp_path}"]) == f"file://{tmp_path}/x.json"
    assert files.first_existing(spark, [f"file://{tmp_path}/no.json"]) is None


def test_formats_and_routes(spark):
    rows = [("a.PNG", b""), ("b.jpeg", b""), ("c", b"\x89PNG\r\n"), ("d.bin", b"\xff\xd8\xff\xe0"), ("e", b"GIF8"), ("f", b"BMxx"), ("g", b"")]
    df = spark.createDataFrame(rows, "n string, c binary")
    assert [r.f for r in df.select(files.image_format(F.col("n"), F.col("c")).alias("f")).collect()] == ["png", "jpg", "png", "jpg", "gif", "bmp", "unknown"]
    paths = ["x.pptx", "x.DOCX", "x.htm", "x.md", "x.tsv", "x.webp", "x.exe", "x"]
    assert [r.r for r in spark.createDataFrame([(p,) for p in paths], "p string").select(files.route(F.col("p")).alias("r")).collect()] == ["slides", "document", "web", "text", "grid", "image", "skipped", "skipped"]


def test_images_of_documents_with_context(spark, tmp_path):
    para = lambda text, image=None: f'<w:p><w:r><w:t>{text}</w:t></w:r>{f"<a:blip r:embed={chr(34)}{image}{chr(34)}/>" if image else ""}</w:p>'
    body = para("far") + para("") * 4 + para("", "r1") + para("") + para("after") + para("own", "r2") + para("") * 3 + para("", "r1")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationship Id="r1" Target="media/1.png"/><Relationship Id="r2" Target="media/2.png"/>')
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    got = {(r.target, r.idx): r.context for r in files.document_images(files.scan(spark, str(tmp_path), "*.docx")).collect()}
    first = min(i for t, i in got if t == "media/1.png")
    assert got[("media/1.png", first)] == "after" and set(got.values()) == {"after", "own", ""}


def test_file_systems_are_named(tmp_path):
    assert isinstance(log._opened(str(tmp_path))[0], pafs.LocalFileSystem) and json.loads("{}") == {}
