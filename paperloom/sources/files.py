"""File sources: recursive scans, OOXML slides and documents read from their zip parts, image sniffing.

Binary files come through Spark's ``binaryFile`` source, so any file system that Spark reads will do. Only
the unzipping needs Python; it runs in Arrow batches and yields raw XML, which SQL expressions take apart.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of all files below a folder, without lock files (``~$``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def zip_parts(files: DataFrame, pattern: str) -> DataFrame:
    """(path, part, xml) of the zip entries whose name matches; a file that is no zip has none."""
    match = re.compile(pattern)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if match.search(n)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "part", "xml"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, xml string")


def slides(files: DataFrame) -> DataFrame:
    """(path, slide_num, text, keywords) of presentations, numbered by their parts' numbers."""
    parts = zip_parts(files, r"^ppt/slides/slide[0-9]+\.xml$")
    runs = F.regexp_extract_all("xml", F.lit("<a:t[^>]*>([^<]*)</a:t>"), F.lit(1))
    number = F.regexp_extract("part", "slide([0-9]+)", 1).cast("int")
    return parts.select("path", number.alias("slide_num"), X.text_runs(F.col("xml"), "a:t").alias("text"), X.keywords(runs).alias("keywords"))


def paragraphs(files: DataFrame) -> DataFrame:
    """(path, idx, text, images) of word-processing documents: each paragraph and the ids of the images in it."""
    parts = zip_parts(files, r"^word/document\.xml$")
    each = parts.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit("(?s)<w:p[ >].*?</w:p>"), F.lit(0))).alias("idx", "p"))
    return each.select("path", "idx", F.array_join(F.regexp_extract_all("p", F.lit("<w:t[^>]*>([^<]*)</w:t>"), F.lit(1)), "").alias("text"), F.regexp_extract_all("p", F.lit('r:embed="([^"]+)"'), F.lit(1)).alias("images"))


def relationships(files: DataFrame, pattern: str = r"_rels/.*\.rels$") -> DataFrame:
    """(path, part, id, target) of all relationship parts."""
    parts = zip_parts(files, pattern)
    tags = parts.select("path", "part", F.explode(F.regexp_extract_all("xml", F.lit("<Relationship [^>]*>"), F.lit(0))).alias("tag"))
    return tags.select("path", "part", F.regexp_extract("tag", 'Id="([^"]*)"', 1).alias("id"), F.regexp_extract("tag", 'Target="([^"]*)"', 1).alias("target"))


def document_images(files: DataFrame, around: int = 3) -> DataFrame:
    """(path, target, idx, context): images of documents with their paragraph's text, or the nearest within ``around``."""
    p = paragraphs(files)
    # what is near comes from windows over a document's paragraphs: no image meets all of them
    line = F.when(X.strip(F.col("text")) != "", F.struct(F.col("idx").alias("at"), F.col("text")))
    w = Window.partitionBy("path").orderBy("idx")
    p = p.withColumns({"_up": F.last(line, ignorenulls=True).over(w.rowsBetween(-around, 0)), "_down": F.first(line, ignorenulls=True).over(w.rowsBetween(0, around))})
    off = lambda c: F.struct(F.abs(F.col(f"{c}.at") - F.col("idx")).alias("off"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.text").alias("text"))
    best = F.array_min(F.filter(F.array(F.when(F.col("_up").isNotNull(), off("_up")), F.when(F.col("_down").isNotNull(), off("_down"))), lambda x: x.isNotNull()))
    near = F.when(best["off"] <= around, best["text"])
    used = p.select("path", "idx", F.coalesce(near, F.lit("")).alias("context"), F.explode("images").alias("id"))
    rels = relationships(files, r"^word/_rels/document\.xml\.rels$").select("path", "id", "target")
    return used.join(rels, ["path", "id"]).select("path", "target", "idx", "context").distinct()


def first_existing(spark, candidates: list[str]) -> str | None:
    """The first path of a list that is there, on any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        at = jvm.org.apache.hadoop.fs.Path(c)
        if at.getFileSystem(conf).exists(at):
            return c
    return None


def slide_images(files: DataFrame) -> DataFrame:
    """(path, target, slide_num): images of presentations; of several slides the last."""
    rels = relationships(files, r"^ppt/slides/_rels/slide[0-9]+\.xml\.rels$").where(F.col("target").contains("media/"))
    return rels.groupBy("path", "target").agg(F.max(F.regexp_extract("part", "slide([0-9]+)", 1).cast("int")).alias("slide_num"))


def image_format(name: Column, content: Column) -> Column:
    """By the name's ending, else by the first bytes."""
    ending = F.lower(F.regexp_extract(name, "[.]([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    known = F.when(ending.isin("png", "gif", "bmp", "webp", "svg"), ending).when(ending.isin("jpg", "jpeg"), "jpg")
    return F.coalesce(known, F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpg").when(head == "47494638", "gif").when(head.startswith("424D"), "bmp").otherwise("unknown"))


def route(path: Column) -> Column:
    """Which reader a file goes to, by its ending."""
    ending = F.lower(F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1))
    return F.when(ending.isin("pptx"), "slides").when(ending.isin("docx"), "document").when(ending.isin("html", "htm"), "web").when(ending.isin("md", "txt"), "text").when(ending.isin("csv", "tsv"), "grid").when(ending.isin("png", "jpg", "jpeg", "gif", "bmp", "webp"), "image").otherwise("skipped")


def first_non_empty(*frames: DataFrame) -> DataFrame:
    """The first source that has rows; the last if none has."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]
