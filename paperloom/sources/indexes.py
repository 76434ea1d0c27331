"""JSON indexes and provider payloads as rows, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import drawings as D
from . import log


def read_slide_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A slide index as one JSON text, or as one a line, as :func:`write_slide_index` writes it."""
    return spark.read.schema(schemas.SLIDE_INDEX).json(path, multiLine=not lines)


def slide_entries(index: DataFrame) -> DataFrame:
    """One entry for each slide of a slide index; source_id is ``file::number``."""
    files = index.select(F.explode(F.map_entries("files")).alias("f")).select(F.col("f.key").alias("file"), "f.value.*")
    each = files.select("file", "title", F.size("slides").alias("slide_count"), "slide_keywords", F.explode(F.map_entries("slides")).alias("s"))
    words = F.coalesce(F.element_at("slide_keywords", F.col("s.key")), X.no_strings())
    text = X.text_or_empty(F.col("s.value"))
    return each.select(
        F.lit("slide").alias("source_type"), F.concat_ws("::", "file", F.col("s.key")).alias("source_id"), "file", "title", F.col("s.key").cast("int").alias("slide_num"), "slide_count",
        X.embedding_text(X.text_or_empty("title"), words, text).alias("text"), F.left(text, F.lit(200)).alias("display_text"), words.alias("keywords"),
    )


def read_image_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.IMAGE_INDEX).json(path, multiLine=True)


def image_entries(index: DataFrame) -> DataFrame:
    """One entry for each image of an image index."""
    each = index.select(F.explode(F.map_entries("images")).alias("i")).select(F.col("i.key").alias("key"), "i.value.*")
    tags = F.coalesce("search_tags", X.no_strings())
    text = F.concat_ws(" ", "description_hint", "slide_title", F.array_join(tags, " "), F.left(X.text_or_empty("context_text"), F.lit(300)))
    return each.select(F.lit("image").alias("source_type"), F.col("key").alias("source_id"), "source_file", text.alias("text"), F.coalesce("description_hint", "archive_name").alias("display_text"), tags.alias("search_tags"), "format", F.col("slide_number").cast("int").alias("slide_number"))


def write_slide_index(slides: DataFrame, path: str) -> None:
    """Slides (file, title, slide_num, text, keywords) as a JSON index, an index of one file on each line: what goes together is a file's slides, never the whole."""
    number = F.col("slide_num").cast("string")
    entries = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(number.alias("key"), value.alias("value")))))
    by = slides.groupBy("file").agg(F.first("title", ignorenulls=True).alias("title"), entries(F.col("text")).alias("slides"), entries(F.coalesce("keywords", X.no_strings())).alias("slide_keywords"))
    by.select(F.create_map("file", F.struct("title", "slides", "slide_keywords")).alias("files")).write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_log(df: DataFrame, path: str, transaction: str | None = None) -> None:
    """Appends records as JSON lines, in one transaction: all of them or none, and none if the named transaction was there before."""
    log.append(df, path, transaction)


def publish_replacement(drawings: DataFrame, key: str, svg: str, pairs: dict[str, str], path: str, dry_run: bool = False) -> DataFrame:
    """(key, n): the number of places of each drawing. All drawings are published, replaced, by one transaction of a log that hides what was there; a dry run writes nothing."""
    found = D.replaced(drawings, key, svg, pairs)
    if not dry_run:
        log.append(found.select(key, svg), path, replace=True)
    return found.select(key, "n")


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """One folder for each key, e.g. notes by title."""
    df.write.mode("overwrite").partitionBy(key).text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _rows(payload: Column, schema: str, list_name: str) -> Column:
    return F.explode(F.from_json(payload, schema)[list_name])


def openverse(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    item = "results array<struct<title:string,creator:string,license:string,license_version:string,license_url:string,width:int,height:int,url:string>>"
    r = payloads.select(_rows(F.col(payload), item, "results").alias("r"))
    return r.where(F.coalesce("r.url", F.lit("")) != "").select(F.lit("openverse").alias("provider"), F.col("r.title"), F.col("r.creator").alias("author"), F.trim(F.concat_ws(" ", F.col("r.license"), F.col("r.license_version"))).alias("license"), F.col("r.license_url"), F.col("r.width"), F.col("r.height"), F.col("r.url"))


def wikimedia(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Pages of a query, keyed by id; the extended metadata has markup that is taken out."""
    from ..operators.structure import strip_html

    info = "struct<url:string,width:int,height:int,extmetadata:map<string,struct<value:string>>>"
    q = payloads.select(F.explode(F.map_values(F.from_json(payload, f"query struct<pages:map<string,struct<title:string,imageinfo:array<{info}>>>>")["query"]["pages"])).alias("p"))
    r = q.select(F.col("p.title").alias("title"), F.element_at("p.imageinfo", 1).alias("i")).where("i.url is not null")
    meta = lambda k: strip_html(X.text_or_empty(F.element_at("i.extmetadata", k)["value"]))
    return r.select(F.lit("wikimedia").alias("provider"), F.regexp_replace("title", "^File:", "").alias("title"), meta("Artist").alias("author"), meta("LicenseShortName").alias("license"), meta("LicenseUrl").alias("license_url"), F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("i.url").alias("url"))


def pexels(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    item = "photos array<struct<alt:string,photographer:string,width:int,height:int,src:struct<original:string>>>"
    r = payloads.select(_rows(F.col(payload), item, "photos").alias("r"))
    return r.where("r.src.original is not null").select(F.lit("pexels").alias("provider"), F.col("r.alt").alias("title"), F.col("r.photographer").alias("author"), F.lit("Pexels License").alias("license"), F.lit("").alias("license_url"), F.col("r.width"), F.col("r.height"), F.col("r.src.original").alias("url"))


def pixabay(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    item = "hits array<struct<tags:string,user:string,imageWidth:int,imageHeight:int,largeImageURL:string>>"
    r = payloads.select(_rows(F.col(payload), item, "hits").alias("r"))
    return r.where("r.largeImageURL is not null").select(F.lit("pixabay").alias("provider"), F.col("r.tags").alias("title"), F.col("r.user").alias("author"), F.lit("Pixabay Content License").alias("license"), F.lit("").alias("license_url"), F.col("r.imageWidth").alias("width"), F.col("r.imageHeight").alias("height"), F.col("r.largeImageURL").alias("url"))


#: Parsers by provider.
PROVIDERS = {"openverse": openverse, "wikimedia": wikimedia, "pexels": pexels, "pixabay": pixabay}


def decode_vectors(rows: DataFrame, blob: str, out: str = "embedding") -> DataFrame:
    """Little-endian 32-bit floats of a binary column as an array column, in Arrow batches."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: [None if b is None else np.frombuffer(b, "<f4") for b in pdf[blob]]}).drop(columns=[blob])

    kept = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != blob)
    return rows.mapInPandas(run, f"{kept}, {out} array<float>")


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """(filename, problem): missing fields, unknown states and repeated names."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    single = jobs.select("filename", F.explode(F.filter(F.array(F.when(empty("filename"), F.lit("no filename")), F.when(empty("prompt"), F.lit("no prompt")), F.when(~F.col("status").isin(*schemas.JOB_STATES), F.lit("unknown status"))), lambda p: p.isNotNull())).alias("problem"))
    twice = jobs.where(~empty("filename")).groupBy("filename").agg(F.count("*").alias("n")).where("n > 1").select("filename", F.lit("repeated").alias("problem"))
    return single.unionByName(twice)
