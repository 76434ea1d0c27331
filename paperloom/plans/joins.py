"""Queries of joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import matching as M
from ..operators import regions as R
from ._registry import query


@query("SELECT d.doc_id, d.source, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id ORDER BY d.source, d.doc_id")
def left_join_entries(t):
    d, e = t("documents").select("doc_id", "source"), t("embeddings").select("vec_id", "label")
    return d.join(e, d.doc_id == e.vec_id, "left").select("doc_id", "source", "label").orderBy("source", "doc_id")


@query("SELECT e.vec_id, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def positional_lookup(t):
    return t("embeddings").join(t("documents"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "lang")


@query(
    """WITH new AS (SELECT c_custkey AS k, arg_max(v, i) AS v FROM (SELECT o_custkey AS c_custkey, o_totalprice AS v, o_orderkey AS i FROM orders) GROUP BY 1)
    SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new"""
)
def upsert_by_key(t):
    stored = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("i"))
    return J.upsert(stored, new, "k", F.col("i"))


@query(
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'deleted' WHEN a.m <> b.m THEN 'modified' ELSE 'unchanged' END AS change
    FROM (SELECT o_orderkey AS k, o_orderstatus AS m FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS m FROM orders WHERE o_orderkey % 7 <> 0) b ON a.k = b.k"""
)
def change_diff(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("m"))
    return J.detect_changes(o.where("k % 5 != 0"), o.where("k % 7 != 0").withColumn("m", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("m"))), "k", "m")


_STEM = "doc_id || '_' || array_to_string(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')[1:4], '_')"
_TITLE = f"""CASE doc_id % 5 WHEN 0 THEN {_STEM} WHEN 1 THEN '(' || replace({_STEM}, '_', ' - ') || ')' WHEN 2 THEN 'Page: ' || doc_id || ' of ' || source
    WHEN 3 THEN array_to_string(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')[2:4], ' ') ELSE 'w' || doc_id END"""
_NORM = "trim(lower(regexp_replace({}, '[^a-zA-Z0-9一-鿿]+', '_', 'g')), '_')"
_NUM = "CAST(nullif(coalesce(nullif(regexp_extract({0}, '^ *([0-9]{{1,3}})', 1), ''), regexp_extract(lower({0}), '^ *(?:slide|page|p) *[-_:]? *([0-9]{{1,3}})', 1)), '') AS INTEGER)"


@query(
    f"""WITH s AS (SELECT doc_id AS stem_id, stem, {_NORM.format("stem")} AS norm, {_NUM.format("stem")} AS num FROM (SELECT doc_id, {_STEM} AS stem FROM documents)),
    t AS (SELECT doc_id AS entry, title, {_NORM.format("title")} AS norm, {_NUM.format("title")} AS num FROM (SELECT doc_id, {_TITLE} AS title FROM documents)),
    n AS (SELECT norm, min(stem_id) AS stem_id FROM s WHERE norm <> '' GROUP BY norm HAVING count(*) = 1), m AS (SELECT num, min(stem_id) AS stem_id FROM s WHERE num IS NOT NULL GROUP BY num HAVING count(*) = 1),
    e AS (SELECT t.*, x.stem_id AS a, n.stem_id AS b, m.stem_id AS c FROM t LEFT JOIN (SELECT stem, min(stem_id) AS stem_id FROM s GROUP BY stem) x ON x.stem = t.title LEFT JOIN n ON n.norm = t.norm LEFT JOIN m ON m.num = t.num),
    i AS (SELECT e.entry, min(s.stem_id) AS d FROM e JOIN s ON e.a IS NULL AND e.b IS NULL AND e.c IS NULL AND e.norm <> '' AND contains(s.norm, e.norm) GROUP BY e.entry HAVING count(*) = 1)
    SELECT entry, coalesce(a, b, c, d) AS stem_id, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 WHEN d IS NOT NULL THEN 4 ELSE 0 END AS tier FROM e LEFT JOIN i USING (entry)"""
)
def tiered_title_match(t):
    """Documents' titles, written in five ways, matched to their stems: as they are, normalised, by number, by a part."""
    # the split ends after the words that stems have
    words = F.slice(F.filter(F.split("text", r"[ \t\r\n\f\x0B]+", 6), lambda w: w != ""), 1, 4)
    d = t("documents").select("doc_id", "source", words.alias("w"))
    stem = F.concat(F.col("doc_id"), F.lit("_"), F.array_join(F.slice("w", 1, 4), "_"))
    kind = F.col("doc_id") % 5
    title = F.when(kind == 0, stem).when(kind == 1, F.concat(F.lit("("), F.replace(stem, F.lit("_"), F.lit(" - ")), F.lit(")"))).when(kind == 2, F.concat(F.lit("Page: "), "doc_id", F.lit(" of "), "source"))
    title = title.when(kind == 3, F.array_join(F.slice("w", 2, 3), " ")).otherwise(F.concat(F.lit("w"), "doc_id"))
    return M.match_titles(d.select(F.col("doc_id").alias("entry"), title.alias("title")), "title", "entry", d.select(F.col("doc_id").alias("stem_id"), stem.alias("stem")), "stem", "stem_id")


_HALF = "trim(regexp_replace(translate({0}, '（）：', '():'), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"


@query(
    f"""WITH m AS (SELECT old, arg_max(new, place) AS new, min(place) AS place FROM (SELECT item_id AS place, array_to_string(string_split(text, ' ')[1:4], ' ') || ' (' || item_id % 7 || '):' AS old, '<' || item_id || '>' AS new FROM benchmark
            UNION ALL SELECT 1000000 + item_id, array_to_string(string_split(text, ' ')[1:3], ' '), '[' || item_id || ']' FROM benchmark) GROUP BY old),
    x AS (SELECT 'line:' || doc_id || ':' || i AS entry, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
        UNION ALL SELECT 'item:' || item_id, CASE item_id % 3 WHEN 0 THEN ' ' || array_to_string(string_split(text, ' ')[1:4], ' ') || ' (' || item_id % 7 || '):' WHEN 1 THEN array_to_string(string_split(text, ' ')[1:4], '  ') || ' （' || item_id % 7 || '）：' ELSE text END FROM benchmark),
    t AS (SELECT entry, regexp_replace(text, '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g') AS text FROM x),
    a AS (SELECT entry, new FROM t JOIN m ON text = old WHERE text <> ''),
    b AS (SELECT entry, arg_min(new, place) AS new FROM t JOIN m ON {_HALF.format("text")} = {_HALF.format("old")} WHERE text <> '' AND entry NOT IN (SELECT entry FROM a) GROUP BY entry),
    c AS (SELECT entry, arg_min(replace(text, old, new), place) AS new FROM t JOIN m ON length(old) > 4 AND contains(text, old) WHERE text <> '' AND entry NOT IN (SELECT entry FROM a) AND entry NOT IN (SELECT entry FROM b) GROUP BY entry)
    SELECT t.entry, md5(coalesce(a.new, b.new, c.new)) AS replaced, CASE WHEN a.new IS NOT NULL THEN 1 WHEN b.new IS NOT NULL THEN 2 WHEN c.new IS NOT NULL THEN 3 ELSE 0 END AS tier
    FROM t LEFT JOIN a USING (entry) LEFT JOIN b USING (entry) LEFT JOIN c USING (entry)"""
)
def tiered_replacement(t):
    """Lines of documents, and openings of items in three forms, replaced by a map from items' openings."""
    b = t("benchmark").select("item_id", "text", F.split("text", " ").alias("w"), (F.col("item_id") % 7).cast("string").alias("n"))
    words = lambda k, by: F.array_join(F.slice("w", 1, k), by)
    long = b.select(F.col("item_id").alias("at"), F.concat(words(4, " "), F.lit(" ("), "n", F.lit("):")).alias("old"), F.concat(F.lit("<"), "item_id", F.lit(">")).alias("new"))
    short = b.select(F.col("item_id") + 1000000, words(3, " "), F.concat(F.lit("["), "item_id", F.lit("]")))
    kind = F.col("item_id") % 3
    form = F.when(kind == 0, F.concat(F.lit(" "), words(4, " "), F.lit(" ("), "n", F.lit("):"))).when(kind == 1, F.concat(words(4, "  "), F.lit(" （"), "n", F.lit("）："))).otherwise(F.col("text"))
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n"))).select(F.concat_ws(":", F.lit("line"), "doc_id", "pos").alias("entry"), F.col("col").alias("text"))
    texts = lines.union(b.select(F.concat_ws(":", F.lit("item"), "item_id"), form))
    return M.match_replacements(texts, "text", "entry", long.union(short), "old", "new", "at").select("entry", F.md5("replaced").alias("replaced"), "tier")


@query(
    """SELECT n_name, coalesce(x.to_name, y.to_name) AS translated FROM nation LEFT JOIN (SELECT r_name AS f, 'R:' || r_name AS to_name FROM region) x ON n_name = f
    LEFT JOIN (SELECT 'NATION_' || r_regionkey AS f2, 'T' || r_regionkey AS to_name FROM region) y ON trim(n_name) = f2"""
)
def translation_lookup(t):
    exact = t("region").select(F.col("r_name").alias("n_name"), F.concat(F.lit("R:"), "r_name").alias("x"))
    stripped = t("region").select(F.concat(F.lit("NATION_"), "r_regionkey").alias("key"), F.concat(F.lit("T"), "r_regionkey").alias("y"))
    n = t("nation").select("n_name", F.trim("n_name").alias("key"))
    return n.join(exact, "n_name", "left").join(stripped, "key", "left").select("n_name", F.coalesce("x", "y").alias("translated"))


@query("SELECT DISTINCT n_name FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || r_regionkey FROM region)")
def unmapped_texts(t):
    return t("nation").join(t("region").select(F.concat(F.lit("NATION_"), "r_regionkey").alias("n_name")), "n_name", "left_anti").select("n_name").distinct()


@query("SELECT term, count(*) AS n FROM documents, (SELECT unnest(['license', 'stupid', 'der', 'que']) AS term) WHERE contains(lower(text), term) GROUP BY term")
def term_by_document(t):
    hits = F.filter(F.array(*[F.lit(x) for x in ("license", "stupid", "der", "que")]), lambda x: F.contains(F.lower("text"), x))
    return t("documents").select(F.explode(hits).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT 'orphan' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'missing', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def orphans_and_missing(t):
    d, e = t("documents").select(F.col("doc_id").alias("id")), t("embeddings").select(F.col("vec_id").alias("id"))
    return d.join(e, "id", "left_anti").select(F.lit("orphan").alias("kind"), "id").union(e.join(d, "id", "left_anti").select(F.lit("missing").alias("kind"), "id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_notes(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer UNION SELECT c_custkey, c_custkey // 3 FROM customer), r AS (SELECT 97 AS node UNION SELECT dst FROM r JOIN e ON r.node = e.src) SELECT CAST(node AS BIGINT) AS node FROM r")
def relationship_closure(t):
    c = t("customer")
    edges = c.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst")).union(c.select("c_custkey", F.expr("c_custkey div 3"))).distinct()
    return J.closure(edges, t.spark.range(97, 98).select(F.col("id").alias("node")))


@query("SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(range(1, 65), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE))) > 0.45")
def near_dup_pairs(t):
    from ..operators import dedup as G

    return G.similar_pairs(t("embeddings"), 0.45)


@query("SELECT l_orderkey, l_linenumber, s_suppkey AS box FROM lineitem JOIN supplier ON l_extendedprice / 100 BETWEEN s_acctbal AND s_acctbal + 5")
def range_containment(t):
    points = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("x"))
    boxes = t("supplier").select(F.col("s_suppkey").alias("box"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return J.bucket_range_join(points, boxes, "x", "low", "high", 5.0).select("l_orderkey", "l_linenumber", "box")


_PLACE = f"l_partkey * 7919 % {R.SLIDE_WIDTH} AS x, l_suppkey * 104729 % {R.SLIDE_HEIGHT} AS y"
_BOX = f"s_suppkey % 4 AS page, s_suppkey AS box, s_suppkey * 15485863 % {R.SLIDE_WIDTH} AS x0, s_suppkey * 32452843 % {R.SLIDE_HEIGHT} AS y0"


@query(
    f"""WITH p AS (SELECT l_orderkey % 4 AS page, l_orderkey, l_linenumber, {_PLACE} FROM lineitem),
    b AS (SELECT *, CASE WHEN box % 9 = 0 THEN NULL ELSE x0 + (1 << CAST(box % 21 AS INT)) END AS x1, y0 + (1 << CAST(box % 19 AS INT)) AS y1 FROM (SELECT {_BOX} FROM supplier))
    SELECT l_orderkey, l_linenumber, box FROM p JOIN b ON p.page = b.page AND x BETWEEN x0 AND coalesce(x1, {R.SLIDE_WIDTH}) AND y BETWEEN y0 AND y1"""
)
def region_join(t):
    """Points of four slides in boxes of unlike sizes, some open to the right."""
    points = t("lineitem").selectExpr("l_orderkey % 4 as page", "l_orderkey", "l_linenumber", *_PLACE.split(", "))
    boxes = t("supplier").selectExpr(*_BOX.split(", ")).selectExpr("*", "if(box % 9 = 0, null, x0 + shiftleft(1L, cast(box % 21 as int))) as x1", "y0 + shiftleft(1L, cast(box % 19 as int)) as y1")
    return R.in_regions(points, boxes, "page", "x", "y", least=4096).select("l_orderkey", "l_linenumber", "box")


_LAYOUT_ROWS = [(layout, region, *map(float, sides)) for layout, found in R.LAYOUTS.items() for region, sides in found.items()]


@query(
    f"""SELECT layout, region, count(*) AS n FROM (SELECT {_PLACE} FROM lineitem) JOIN (VALUES {", ".join(f"('{a}', '{b}', {x0}, {x1}, {y0}, {y1})" for a, b, x0, x1, y0, y1 in _LAYOUT_ROWS)}) v(layout, region, x0, x1, y0, y1)
    ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL"""
)
def layout_regions(t):
    """Points counted by the regions of the usual layouts; a point on a border is in both."""
    points = t("lineitem").selectExpr("0 as page", *_PLACE.split(", "))
    regions = t.spark.createDataFrame([(0, *r) for r in _LAYOUT_ROWS], "page int, layout string, region string, x0 double, x1 double, y0 double, y1 double")
    return R.in_regions(points, regions, "page", "x", "y", least=1 << 20).groupBy("layout", "region").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT l_partkey AS k, arg_max(l_quantity, o) AS v, min(o) AS first FROM (SELECT l_partkey, l_quantity, l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS o FROM lineitem WHERE l_partkey IS NOT NULL) GROUP BY 1),
    p AS (SELECT p_partkey AS k, p_retailprice AS v, p_size * 1000000 + p_partkey AS o FROM part WHERE p_partkey % 2 = 0)
    SELECT p.k, coalesce(n.v, p.v) AS v, 0 AS part, CAST(p.o AS BIGINT) AS at_place FROM p LEFT JOIN n USING (k) UNION ALL SELECT k, v, 1, first FROM n WHERE k NOT IN (SELECT k FROM p)"""
)
def manifest_merge(t):
    """Parts as a manifest, all order lines as new entries."""
    old = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), F.expr("cast(p_size * 1000000 + p_partkey as bigint)").alias("o"))
    new = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"), F.expr("l_orderkey * 1000 + l_linenumber * 100 + cast(l_quantity as bigint)").alias("o"))
    return J.merged_manifest(old, new, "k", "o").select("k", "v", F.col("place.part").alias("part"), F.col("place.at").alias("at_place"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size * 1.0 WHEN p_size > 20 THEN p_size * 914400 / 9525.0 ELSE 960.0 END AS width, coalesce(n, 1) AS usage FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def display_metadata_fallback(t):
    used = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    inches, emu = F.when(F.col("p_size") > 40, F.col("p_size") * 1.0), F.when(F.col("p_size") > 20, F.col("p_size") * 914400 / 9525.0)
    return t("part").join(used, "p_partkey", "left").select("p_partkey", F.coalesce(inches.cast("double"), emu.cast("double"), F.lit(960.0)).alias("width"), F.coalesce("n", F.lit(1)).alias("usage"))
