"""Things that are looked up by name: rules from files, checks, settings, providers, embedding backends, vector engines.

Registries are dictionaries; what they give is a function of DataFrames. A caller adds entries; nothing here is imported by name from
what a table says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dedup, gates, search

# ---- rules from files


def stage_templates(text: str) -> list[dict]:
    """The stages of a YAML rule file, in the order of their numbers, as :func:`gates.stage_match` takes them.

    ``stages`` is a list of id, label, keywords, synonyms, order and required; what is missing is empty, in the file's order, not required.
    """
    import yaml

    found = (yaml.safe_load(text) or {}).get("stages") or []
    rows = [{"id": str(s["id"]), "label": str(s.get("label", s["id"])), "keywords": [str(x) for x in s.get("keywords") or []], "synonyms": [str(x) for x in s.get("synonyms") or []], "order": int(s.get("order", n)), "required": bool(s.get("required", False))} for n, s in enumerate(found, 1)]
    return sorted(rows, key=lambda s: s["order"])


# ---- checks

#: Severity of an issue by its type; of the others an issue is a warning.
SEVERITY = {"C1_PLACEHOLDER": "error", "C2_EMPTY_PAGE": "error", "C7_GARBLED": "error"}


def _shaped(issues: DataFrame, kind: str, page: str | None = "page", tier: Column | None = None) -> DataFrame:
    number = F.col(page).cast("long") if page else F.lit(None).cast("long")
    return issues.select("deck", number.alias("page"), F.lit(kind).alias("type"), (F.lit(None).cast("string") if tier is None else tier).alias("tier"))


#: Checks of single pages, which one pass makes together.
PAGE_CHECKS = ("C1_PLACEHOLDER", "C2_EMPTY_PAGE", "C3_CONTENT_MATCH", "C7_GARBLED")


def _one_type(kind: str):
    def check(pages: DataFrame, source: DataFrame | None) -> DataFrame:
        return _shaped(gates.page_checks(pages, "deck", "page", "text").where(F.col("type") == kind), kind)

    return check


def _redundant(pages: DataFrame, source: DataFrame | None) -> DataFrame:
    """C4: a page that says much the same as the page before it."""
    turns = pages.select("deck", "page").withColumn("nxt", F.lead("page").over(Window.partitionBy("deck").orderBy("page"))).where("nxt is not null")
    tf = dedup.term_frequencies(pages, ["deck", "page"], words(F.col("text")))
    sims = dedup.tf_cosine(tf, turns, ["deck", "page"], ["deck", "nxt"], ["deck", "page"])
    return _shaped(sims.where("sim > 0.75"), "C4_REDUNDANCY", None)


def _continuity(pages: DataFrame, source: DataFrame | None) -> DataFrame:
    """C5: a page number that doesn't follow the one before it."""
    before = F.lag("page").over(Window.partitionBy("deck").orderBy("page"))
    return _shaped(pages.select("deck", "page", before.alias("before")).where("page != before + 1"), "C5_CONTINUITY")


def _coverage(pages: DataFrame, source: DataFrame | None) -> DataFrame:
    """C6: a deck that has too few of the source's commonest words. ``source``: (deck, text)."""
    if source is None:
        return pages.sparkSession.createDataFrame([], "deck long, page long, type string, tier string")
    tf = dedup.term_frequencies(source, ["deck"], F.filter(words(F.col("text")), lambda w: F.length(w) >= 2))
    rank = F.row_number().over(Window.partitionBy("deck").orderBy(F.desc("tf"), "tok"))
    top = tf.select("deck", "tok", rank.alias("r")).where("r <= 20")
    have = pages.select("deck", F.explode(words(F.col("text"))).alias("tok")).distinct().withColumn("has", F.lit(1))
    share = top.join(have, ["deck", "tok"], "left").groupBy("deck").agg(F.avg(F.coalesce("has", F.lit(0))).alias("share"))
    return _shaped(share.where("share < 0.5"), "C6_SOURCE_COVERAGE", None)


def _structure(pages: DataFrame, source: DataFrame | None) -> DataFrame:
    """C8: a row for each deck; its tier says whether cover and closing are there."""
    found = gates.structure_check(pages, "deck", "page", "text")
    return _shaped(found, "C8_STRUCTURE", None, F.when(F.col("complete"), "complete").otherwise("incomplete"))


def _outliers(pages: DataFrame, source: DataFrame | None) -> DataFrame:
    """C9: a block of a page that shares almost no words with the page's others. Pages of three blocks (lines) or more."""
    lines = pages.select("deck", "page", F.posexplode(F.split("text", "\n")).alias("n", "text")).where(F.length("text") >= 4)
    found = dedup.outliers(lines, ["deck", "page"], "n", words(F.col("text"))).where("outlier")
    return _shaped(found, "C9_OUTLIER", "page", F.when(F.col("critical"), "critical").otherwise("notice"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[一-鿿]"), F.lit(0))


Check = Callable[[DataFrame, DataFrame | None], DataFrame]
#: The checks of a deck's pages (deck, page, text), in the order in which they run; a caller adds its own, and its type's severity above.
CHECKS: dict[str, Check] = {kind: _one_type(kind) for kind in ("C1_PLACEHOLDER", "C2_EMPTY_PAGE", "C3_CONTENT_MATCH")}
CHECKS |= {"C4_REDUNDANCY": _redundant, "C5_CONTINUITY": _continuity, "C6_SOURCE_COVERAGE": _coverage, "C7_GARBLED": _one_type("C7_GARBLED"), "C8_STRUCTURE": _structure, "C9_OUTLIER": _outliers}


def run_checks(pages: DataFrame, source: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """(deck, page, type, tier, severity) of all checks, or of those named: a critical outlier is critical, a complete structure no issue but a row."""
    names = list(names or CHECKS)
    own = [n for n in names if n in PAGE_CHECKS]
    parts = [CHECKS[n](pages, source) for n in names if n not in own]
    if own:
        parts.insert(0, gates.page_checks(pages, "deck", "page", "text").where(F.col("type").isin(own)).withColumn("page", F.col("page").cast("long")))
    found = reduce(DataFrame.unionByName, (p.select("deck", "page", "type", "tier") for p in parts))
    severity = F.lit("warning")
    for kind, value in SEVERITY.items():
        severity = F.when(F.col("type") == kind, value).otherwise(severity)
    return found.withColumn("severity", F.when((F.col("type") == "C9_OUTLIER") & (F.col("tier") == "critical"), "critical").otherwise(severity))


# ---- settings and references


def settings_for(asked: DataFrame, key: str, settings: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``asked`` with its settings, by name or alias whatever the case and blanks around; nulls where there are none. ``settings``: (name, ...), few rows."""
    name = F.lower(F.trim(F.coalesce(F.col(key), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    return asked.withColumn("name", F.coalesce(F.try_element_at(known, name), name)).join(settings, "name", "left")


def dangling_references(config: DataFrame, targets: DataFrame) -> DataFrame:
    """(slide, group, problem): what a configuration (slide, group; a null group for the slide's own entry) names and the deck (slide, group) hasn't.

    A missing slide is one problem, whatever groups are named under it.
    """
    slides = targets.select("slide").distinct()
    lost = config.select("slide").distinct().join(slides, "slide", "left_anti").select("slide", F.lit(None).cast("string").alias("group"), F.lit("missing slide").alias("problem"))
    there = config.where("group is not null").join(slides, "slide", "left_semi")
    return lost.unionByName(there.join(targets, ["slide", "group"], "left_anti").select("slide", "group", F.lit("missing group").alias("problem")).distinct())


# ---- providers and queues

#: Providers of candidates by name: each is a function of a session that gives (query_id, candidate_id, score, ...).
PROVIDERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def merged_candidates(found: dict[str, DataFrame], pool: int = 8) -> DataFrame:
    """(provider, query_id, candidate_id, score, valid, rank): the best ``pool`` of each query over all providers; ties by provider and id.

    Candidates of a query are cut to the pool before they are ranked, on the map side.
    """
    every = reduce(DataFrame.unionByName, (d.select(F.lit(p).alias("provider"), "query_id", "candidate_id", "score", "valid") for p, d in found.items()))
    every = every.where("score is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "provider", "candidate_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= pool)


def first_valid(ranked: DataFrame) -> DataFrame:
    """(query_id, provider, candidate_id): of each query's pool the first that is valid."""
    best = ranked.where("valid").groupBy("query_id").agg(F.min(F.struct("rank", "provider", "candidate_id")).alias("b"))
    return best.select("query_id", "b.provider", "b.candidate_id")


def retry_plan(attempts: DataFrame, start: int, most: int = 3) -> DataFrame:
    """(item, status, tries, retry, concurrency) from a log of attempts (item, batch, status, rate_limited).

    An item's status is its last; it is tried again unless it was generated or has been tried ``most`` times. Concurrency is halved, to one at least, for
    each batch that met a rate limit.
    """
    halved = F.greatest(F.lit(1), F.floor(F.lit(start) / F.pow(F.lit(2.0), F.col("hits"))).cast("int"))
    limits = attempts.where("rate_limited").agg(F.countDistinct("batch").alias("hits")).select(halved.alias("concurrency"))
    last = attempts.groupBy("item").agg(F.max_by("status", "batch").alias("status"), F.count("*").alias("tries"))
    # limits is a single row
    return last.withColumn("retry", (F.col("status") != "Generated") & (F.col("tries") < most)).join(F.broadcast(limits))


# ---- embeddings and engines

#: Embedding backends by name: a function of a model's path that gives one from texts (a Column of words) to a Column of vectors, or raises.
BACKENDS: dict[str, Callable[[str | None], Callable[[Column], Column]]] = {"hashed": lambda model: search.hashed_embedding}


def embedder(name: str = "auto", model: str | None = None) -> tuple[str, Callable[[Column], Column]]:
    """(name, embedding) of a backend; ``auto`` is the first registered one that can be had, the hashed one at last."""
    if name != "auto":
        if name not in BACKENDS:
            raise KeyError(f"no embedding backend {name!r}; there are {sorted(BACKENDS)}")
        return name, BACKENDS[name](model)
    for found in [n for n in BACKENDS if n != "hashed"]:
        try:
            return found, BACKENDS[found](model)
        except (ImportError, OSError, ValueError, TypeError):
            continue
    return "hashed", BACKENDS["hashed"](model)


class VectorEngine:
    """An index of vectors that is a table: add, search, save, load. This one searches exactly; others override :meth:`search`."""

    schema = "vec_id long, embedding array<double>"

    def __init__(self, spark: SparkSession, vectors: DataFrame | None = None):
        self.spark = spark
        self.vectors = spark.createDataFrame([], self.schema) if vectors is None else vectors

    def add(self, vectors: DataFrame) -> VectorEngine:
        """With these vectors too; of an id that is there already the new one holds."""
        old = self.vectors.join(vectors.select("vec_id"), "vec_id", "left_anti")
        return type(self)(self.spark, old.unionByName(vectors.select("vec_id", "embedding")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.vector_topk_many(self.vectors, queries, k)

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorEngine:
        return cls(spark, spark.read.parquet(path))


class Lifecycle:
    """A job in three steps, of which a later one runs only if the earlier gave no problems: prepare, execute, validate. Each gives a DataFrame of problems; execute, the result too."""

    def prepare(self) -> DataFrame | None:
        return None

    def execute(self) -> DataFrame:
        raise NotImplementedError

    def validate(self, result: DataFrame) -> DataFrame | None:
        return None

    def run(self) -> tuple[str, DataFrame]:
        """(the step that it ended in, problems or the result)."""
        problems = self.prepare()
        if problems is not None and not problems.isEmpty():
            return "prepare", problems
        result = self.execute()
        problems = self.validate(result)
        return ("validate", problems) if problems is not None and not problems.isEmpty() else ("done", result)
