"""Queries of counts, totals, coverage and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as G
from ..operators import gates as Q
from ._registry import query


@query("SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS slide_count FROM documents")
def count_back_join(t):
    d = t("documents").select("doc_id", "source")
    return d.join(d.groupBy("source").agg(F.count("*").alias("slide_count")), "source").select("doc_id", "source", "slide_count")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY ROLLUP (label)")
def store_stats(t):
    return t("embeddings").rollup("label").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT source) AS files, count(*) AS slides, count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents")
def index_totals(t):
    return t("documents").agg(F.countDistinct("source").alias("files"), F.count("*").alias("slides"), (F.count("*") - F.countDistinct(F.md5("text"))).alias("duplicates"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang ORDER BY n DESC, lang")
def format_histogram(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).orderBy(F.desc("n"), "lang")


@query("SELECT tok, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs FROM (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents) GROUP BY ALL) GROUP BY tok ORDER BY n DESC, tok LIMIT 100")
def tokens_tf_top(t):
    tf = G.term_frequencies(t("documents"), ["doc_id"], X.content_tokens(F.col("text")))
    return tf.groupBy("tok").agg(F.sum("tf").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "tok").limit(100)


_COVERED = """WITH b AS (SELECT tok, count(*) AS n, min((item_id, pos)) AS first FROM (SELECT item_id, unnest(x) AS tok, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM benchmark)) GROUP BY tok),
    top AS (SELECT tok, row_number() OVER (ORDER BY n DESC, first) AS place FROM b ORDER BY n DESC, first LIMIT 20), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM {pages}),
    c AS (SELECT CAST(place AS INT) AS place, tok, tok IN (SELECT tok FROM d) AS covered FROM top)"""


def _coverage(t, pages):
    return Q.keyword_coverage(t("benchmark"), "item_id", X.content_tokens(F.col("text")), pages, X.content_tokens(F.col("text")))


@query(f"{_COVERED.format(pages='documents')} SELECT place, tok, covered FROM c")
def source_coverage(t):
    """The 20 commonest tokens of a source text, and which the pages cover anywhere."""
    return _coverage(t, t("documents"))


@query(f"{_COVERED.format(pages='(SELECT role AS text FROM conversations UNION ALL SELECT lang FROM documents UNION ALL SELECT left(text, 40) FROM conversations)')} SELECT count(*) FILTER (covered) AS covered, count(*) AS total, array_to_string(list(tok ORDER BY place) FILTER (NOT covered)[1:10], ',') AS missing, round(count(*) FILTER (covered) / count(*), 2) AS coverage_rate FROM c")
def coverage_rate(t):
    """How much of the source a deck of short texts covers."""
    c, d = t("conversations"), t("documents")
    pages = c.select(F.col("role").alias("text")).union(d.select("lang")).union(c.select(F.left("text", F.lit(40))))
    return Q.coverage_summary(_coverage(t, pages)).withColumn("missing", F.when(F.size("missing") > 0, F.array_join("missing", ",")))


_PROJECTS = "o_orderpriority AS format, o_custkey % 3 AS errors, o_orderkey % 4 AS warnings, o_orderkey % 5 AS drawing_warnings, o_orderstatus <> 'O' AS has_readme, o_totalprice > 50000 AS has_spec"


@query(
    f"""SELECT format, count(*) AS projects, count(*) FILTER (errors = 0 AND warnings = 0 AND drawing_warnings = 0) AS valid, count(*) FILTER (errors > 0) AS has_errors, count(*) FILTER (errors = 0 AND (warnings > 0 OR drawing_warnings > 0)) AS has_warnings,
    count(*) FILTER (NOT has_readme) AS missing_readme, count(*) FILTER (NOT has_spec) AS missing_spec, count(*) FILTER (drawing_warnings > 0) AS drawing_issues, grouping(format) = 1 AS all_formats FROM (SELECT {_PROJECTS} FROM orders) GROUP BY GROUPING SETS ((format), ())"""
)
def project_validation(t):
    return Q.project_validation(t("orders").selectExpr(*_PROJECTS.split(", ")))


@query("SELECT l_partkey, count(*) AS usage FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def common_assets(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("usage")).where("usage > 1")


@query("SELECT l_suppkey, count(*) AS usage_count, array_to_string(list_sort(list(DISTINCT l_tax)), ',') AS ratios, arg_min(l_tax, (l_orderkey, l_linenumber)) AS first_ratio FROM lineitem GROUP BY 1")
def occurrence_rollup(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("usage_count"), F.array_join(F.array_sort(F.collect_set("l_tax")), ",").alias("ratios"), F.min_by("l_tax", F.struct("l_orderkey", "l_linenumber")).alias("first_ratio"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS skipped, CAST(count(*) FILTER (event_type = 'purchase') * 100 // count(*) AS BIGINT) AS percent FROM events")
def run_summary(t):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    e = F.col("event_type")
    return t("events").agg(F.count("*").alias("total"), n(e == "error").alias("failed"), n(e == "purchase").alias("ok"), n(~e.isin("error", "purchase")).alias("skipped"), F.floor(n(e == "purchase") * 100 / F.count("*")).alias("percent"))


@query("SELECT value, files, array_to_string(names, ',') AS names FROM (SELECT CAST(l_discount AS VARCHAR) AS value, count(DISTINCT l_suppkey) AS files, list_sort(list(DISTINCT l_returnflag)) AS names FROM lineitem GROUP BY 1) ORDER BY files DESC, value")
def drift_rollup(t):
    rows = t("lineitem").groupBy(F.col("l_discount").cast("string").alias("value")).agg(F.countDistinct("l_suppkey").alias("files"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("names"))
    return rows.orderBy(F.desc("files"), "value")


@query("(SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)")
def newest_five(t):
    return t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS projects, count(*) FILTER (o_orderstatus = 'F') AS valid, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def project_catalog(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("projects"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("valid"), F.sum("o_totalprice").alias("total"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def keep_last_50(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION SELECT event_id FROM events WHERE value > 90 ORDER BY 1")
def set_union(t):
    e = t("events")
    return e.where("event_type = 'click'").select("event_id").union(e.where("value > 90").select("event_id")).distinct().orderBy("event_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t):
    return t("documents").select("doc_id").subtract(t("labels").select("doc_id"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations")
def ranked_turns(t):
    return t("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")).cast("long").alias("rank"))


@query("SELECT conv_id, turn, nxt FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE turn % 3 <> 1) WHERE nxt <> turn + 1")
def page_continuity(t):
    pages = t("conversations").where("turn % 3 != 1").select("conv_id", "turn")
    return pages.withColumn("nxt", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt != turn + 1")


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS spent FROM events GROUP BY user_id")
def user_totals(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("spent"))


@query("SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS only_lang, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def common_source_title(t):
    return t("documents").groupBy("source").agg(F.when(F.countDistinct("lang") == 1, F.min("lang")).alias("only_lang"), F.countDistinct("lang").alias("langs"))
