"""Queries of de-duplication and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as G
from ._registry import query


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents")
def exact_dedup_first(t):
    rows = t("documents").select("doc_id", F.md5("text").alias("h"))
    return G.keep_first(rows, ["h"], F.col("doc_id"), "doc_id")


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) AS kept FROM documents")
def exact_dedup_in_file(t):
    rows = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return G.keep_first(rows, ["source", "h"], F.col("doc_id"), "doc_id")


@query("SELECT md5(text) AS h, arg_min(p, doc_id) AS first_key, arg_min(p, (length(p), doc_id)) AS path, count(*) AS copies FROM (SELECT *, source || '/' || doc_id AS p FROM documents) GROUP BY 1")
def dedup_shortest_keep(t):
    rows = t("documents").select("doc_id", F.md5("text").alias("h"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("p"))
    return G.shortest_path_entry(rows, "h", "p", "doc_id")


@query("SELECT h, count(*) AS copies, CAST(sum(n_chars) - arg_min(n_chars, (length(p), p)) AS BIGINT) AS chars_saved FROM (SELECT md5(text) AS h, n_chars, source || '/' || doc_id AS p FROM documents) GROUP BY h HAVING count(*) > 1")
def archive_dedup_report(t):
    rows = t("documents").select(F.md5("text").alias("h"), "n_chars", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("p"))
    return rows.groupBy("h").agg(F.count("*").alias("copies"), (F.sum("n_chars") - F.min_by("n_chars", F.struct(F.length("p"), F.col("p")))).alias("chars_saved")).where("copies > 1")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1)")
def index_pruning(t):
    rows = t("documents").select("doc_id", F.md5("text").alias("h"))
    removed = G.keep_first(rows, ["h"], F.col("doc_id"), "doc_id").where("not kept")
    return rows.join(removed, "doc_id", "left_anti").select("doc_id")


#: Rows with an earlier neighbour, in order; each is dropped if one of these is still there.
_WALK = """low AS MATERIALIZED (SELECT j, before, row_number() OVER (ORDER BY j) AS r FROM (SELECT j, list(i) AS before FROM e GROUP BY j)),
    walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS dropped UNION ALL
        SELECT step + 1, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, j) ELSE dropped END FROM walk JOIN low ON low.r = walk.step + 1)"""


def _greedy(threshold: float) -> str:
    dot = "list_sum(list_transform(range(1, 65), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE)))"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {dot} > {threshold}),
    {_WALK} SELECT vec_id, NOT list_contains((SELECT dropped FROM walk ORDER BY step DESC LIMIT 1), vec_id) AS kept FROM embeddings"""


@query(_greedy(0.45))
def greedy_dedup(t):
    return G.greedy_similar(t("embeddings"), 0.45)


_CLUSTERS = _greedy(0.45).rsplit("SELECT vec_id, NOT", 1)[0] + """, k AS MATERIALIZED (SELECT vec_id, NOT list_contains((SELECT dropped FROM walk ORDER BY step DESC LIMIT 1), vec_id) AS kept FROM embeddings),
    o AS (SELECT e.j AS vec_id, min(e.i) AS owner FROM e JOIN k ON k.vec_id = e.i AND k.kept GROUP BY e.j), c AS (SELECT CASE WHEN kept THEN vec_id ELSE owner END AS cluster, count(*) AS n, count(*) FILTER (kept) AS kept FROM k LEFT JOIN o USING (vec_id) GROUP BY 1)"""


@query(f"{_CLUSTERS} SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(n) - sum(kept) AS BIGINT) AS removed, (sum(n) - sum(kept)) * 100.0 / sum(n) AS removal_rate, count(*) FILTER (n > 1) AS clusters, max(n) FILTER (n > 1) AS largest FROM c")
def dedup_statistics(t):
    return G.removal_statistics(G.greedy_clusters(t("embeddings"), 0.45))


@query(f"SELECT vec_id, kept FROM ({_greedy(0.4)})")
def two_stage_dedup(t):
    """By hash first, then greedily by cosine among the rows that are left."""
    e = t("embeddings").withColumn("h", F.md5(F.array_join("embedding", ",")))
    first = e.join(G.keep_first(e, ["h"], F.col("vec_id"), "vec_id").where("kept"), "vec_id", "left_semi")
    return G.greedy_similar(first, 0.4)


_BOX = "SELECT l_orderkey, l_linenumber, min(l_partkey) % 300 AS x, min(l_suppkey) % 40 AS y, min(l_quantity) AS area FROM lineitem GROUP BY ALL"


def _boxes(t):
    each = t("lineitem").groupBy("l_orderkey", "l_linenumber")
    return each.agg((F.min("l_partkey") % 300).alias("x"), (F.min("l_suppkey") % 40).alias("y"), F.min("l_quantity").alias("area"))


@query(
    f"""WITH RECURSIVE b AS ({_BOX}), r AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber AS n FROM b UNION
    SELECT r.l_orderkey, r.a, q.l_linenumber FROM r JOIN b p ON p.l_orderkey = r.l_orderkey AND p.l_linenumber = r.n JOIN b q ON q.l_orderkey = p.l_orderkey AND abs(p.x - q.x) + abs(p.y - q.y) < 60),
    c AS (SELECT l_orderkey, a, min(n) AS c FROM r GROUP BY 1, 2), w AS (SELECT c.l_orderkey, c.c, sum(b.area) AS total FROM c JOIN b ON b.l_orderkey = c.l_orderkey AND b.l_linenumber = c.a GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY total DESC, c) AS cluster FROM w) SELECT c.l_orderkey, c.a AS l_linenumber, k.cluster FROM c JOIN k USING (l_orderkey, c)"""
)
def geometric_clusters(t):
    return G.geometric_clusters(_boxes(t), "l_orderkey", "l_linenumber", "x", "y", "area", 60)


@query(f"SELECT l_orderkey, l_linenumber, x * y >= 0.6 * 12000 AS background FROM ({_BOX}) WHERE x > 0 AND y > 0 AND NOT (x < 10 AND y < 10)")
def element_filter(t):
    kept = _boxes(t).where("x > 0 and y > 0 and not (x < 10 and y < 10)")
    return kept.select("l_orderkey", "l_linenumber", (F.col("x") * F.col("y") >= 0.6 * 12000).alias("background"))


_CANON = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^(Crawled|Imported):.*$', '\1:', 'g'), '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g')"


@query(f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({_CANON})) AS first_id FROM (SELECT doc_id, 'Crawled: ' || doc_id || chr(13) || chr(10) || text AS text FROM documents)) WHERE doc_id <> first_id")
def equivalent_documents(t):
    """Documents, each with a line of its own time of import, whose content an earlier one has."""
    text = F.concat(F.lit("Crawled: "), F.col("doc_id").cast("string"), F.lit("\r\n"), "text")
    rows = t("documents").select("doc_id", F.md5(X.canonical_content(text)).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "h").where("doc_id != first_id").select("doc_id", "first_id")


_TF = "SELECT conv_id, turn, tok, count(*) AS tf FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM conversations) GROUP BY ALL"


@query(
    f"""WITH tf AS ({_TF}), n AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY ALL), p AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
    d AS (SELECT p.conv_id, p.turn, p.nxt, sum(x.tf * y.tf) AS dot FROM p JOIN tf x ON x.conv_id = p.conv_id AND x.turn = p.turn JOIN tf y ON y.conv_id = p.conv_id AND y.turn = p.nxt AND y.tok = x.tok GROUP BY ALL)
    SELECT p.conv_id, p.turn, p.nxt, coalesce(d.dot / (a.norm * b.norm), 0) AS sim, coalesce(d.dot / (a.norm * b.norm), 0) > 0.75 AS redundant FROM p LEFT JOIN d USING (conv_id, turn, nxt)
    LEFT JOIN n a ON a.conv_id = p.conv_id AND a.turn = p.turn LEFT JOIN n b ON b.conv_id = p.conv_id AND b.turn = p.nxt WHERE p.nxt IS NOT NULL"""
)
def tf_cosine_adjacent(t):
    from pyspark.sql import Window

    turns = t("conversations").select("conv_id", "turn").distinct()
    pairs = turns.withColumn("nxt", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    tf = G.term_frequencies(t("conversations"), ["conv_id", "turn"], X.content_tokens(F.col("text")))
    out = G.tf_cosine(tf, pairs, ["conv_id", "turn"], ["conv_id", "nxt"], ["conv_id", "turn"])
    return out.select("conv_id", "turn", "nxt", "sim", (F.col("sim") > 0.75).alias("redundant"))


#: Order lines as rectangles of a page (an order); every fifth supplier's as a table.
_RECTS = "SELECT page, k, s % 5 = 0 AS is_table, p % 240 AS x, s % 120 AS y, 60 + p % 440 AS w, 60 + s * 7 % 350 AS h FROM (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS k, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH RECURSIVE a AS MATERIALIZED ({_RECTS}), f AS (SELECT * FROM a WHERE NOT is_table AND w >= 100 AND h >= 80 AND w * h >= 30000 AND greatest(w, h) / least(w, h) <= 8 AND NOT EXISTS (SELECT 1 FROM a t WHERE t.is_table AND t.page = a.page
        AND greatest(0, least(a.x + a.w, t.x + t.w) - greatest(a.x, t.x)) * greatest(0, least(a.y + a.h, t.y + t.h) - greatest(a.y, t.y)) > 0.5 * least(a.w * a.h, t.w * t.h))),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, k) AS n FROM f),
    e AS MATERIALIZED (SELECT a.page, a.n AS i, b.n AS j FROM r a JOIN r b ON a.page = b.page AND a.n < b.n AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.9 * b.w * b.h),
    before AS MATERIALIZED (SELECT r.page, r.n, coalesce(list(e.i), []) AS of FROM r LEFT JOIN e ON e.page = r.page AND e.j = r.n GROUP BY ALL),
    walk AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT page FROM r) UNION ALL
        SELECT walk.page, before.n, CASE WHEN len(list_filter(of, lambda x: list_contains(kept, x))) > 0 THEN kept ELSE list_append(kept, before.n) END FROM walk JOIN before ON before.page = walk.page AND before.n = walk.n + 1),
    done AS (SELECT page, arg_max(kept, n) AS kept FROM walk GROUP BY page)
    SELECT r.page, r.k, row_number() OVER (PARTITION BY r.page ORDER BY y, x, k) AS place FROM r JOIN done USING (page) WHERE list_contains(done.kept, r.n)"""
)
def rectangle_suppression(t):
    """On each page (an order), the rectangles that are figures: large enough, no tables, and not in a larger one that stays."""
    each = t("lineitem").groupBy(F.col("l_orderkey").alias("page"), F.expr("l_orderkey * 10 + l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rows = each.selectExpr("page", "k", "s % 5 = 0 as is_table", "p % 240 as x", "s % 120 as y", "60 + p % 440 as w", "60 + s * 7 % 350 as h")
    return G.figure_rectangles(rows.where("not is_table"), "page", "k", rows.where("is_table"), cell=128).withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH blocks AS (SELECT conv_id, turn, text FROM conversations WHERE length(text) >= 4), k AS (SELECT conv_id, count(*) AS n FROM blocks GROUP BY 1 HAVING count(*) >= 3),
    tf AS ({_TF.replace("conversations", "blocks")}), n AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY ALL),
    s AS (SELECT x.conv_id, x.turn, y.turn AS other, sum(x.tf * y.tf) / (any_value(a.norm) * any_value(b.norm)) AS sim FROM tf x JOIN tf y ON x.conv_id = y.conv_id AND x.tok = y.tok AND x.turn <> y.turn
    JOIN n a ON a.conv_id = x.conv_id AND a.turn = x.turn JOIN n b ON b.conv_id = y.conv_id AND b.turn = y.turn GROUP BY ALL),
    m AS (SELECT b.conv_id, b.turn, coalesce(sum(s.sim), 0) / (any_value(k.n) - 1) AS sim FROM blocks b JOIN k USING (conv_id) LEFT JOIN s ON s.conv_id = b.conv_id AND s.turn = b.turn GROUP BY b.conv_id, b.turn),
    g AS (SELECT *, avg(sim) OVER (PARTITION BY conv_id) AS overall FROM m)
    SELECT conv_id, turn, sim, overall, NOT (turn > 5 AND conv_id % 2 = 0) AND sim < 0.01 AND overall > 0.02 AND sim < 0.15 * overall AS outlier, NOT (turn > 5 AND conv_id % 2 = 0) AND sim < 0.01 AND overall > 0.02 AND sim < 0.15 * overall AND (sim < 0.003 OR (overall > 0.03 AND sim < 0.05 * overall)) AS critical FROM g"""
)
def in_page_outliers(t):
    """Blocks of a page (turns of a conversation) that share almost no words with the others; some are footnotes."""
    blocks = t("conversations").where(F.length("text") >= 4)
    top, size = F.lit(1_000_000) * F.col("turn"), F.when(F.col("conv_id") % 2 == 0, 10).otherwise(14)
    return G.outliers(blocks, ["conv_id"], "turn", X.content_tokens(F.col("text")), top, size)
