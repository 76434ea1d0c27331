"""Queries of search and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking as K
from ..operators import search as S
from ._registry import query

TERMS = ["license", "the", "stupid"]
_KW = "string_split(lower(text), ' ')"


_KEYWORD_SCORE = "(" + " + ".join(f"CASE WHEN len(list_filter({_KW}, lambda w: contains(w, '{q}'))) > 0 THEN 2 WHEN contains(lower(text), '{q}') THEN 1 ELSE 0 END" for q in TERMS) + f") / {2 * len(TERMS)}.0"


@query(f"SELECT doc_id, source, score FROM (SELECT doc_id, source, CAST({_KEYWORD_SCORE} AS DOUBLE) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def kw_search_topk(t):
    return S.keyword_search(t("documents"), TERMS, 50, "doc_id", None, F.col("text")).select("doc_id", "source", "score")


_TAGS = "list_distinct([lang, source] || regexp_extract_all(lower(text), '[a-z]+'))"


def _tag_sql(tokens):
    parts = []
    for q in tokens:
        parts.append(
            f"CASE WHEN len(list_filter(tags, lambda g: contains(g, '{q}') OR contains('{q}', g))) > 0 THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(source), '{q}') THEN 2.0 ELSE 0 END"
            f" + CASE WHEN contains(lower(lang), '{q}') THEN 2.0 ELSE 0 END + least((length(low) - length(replace(low, '{q}', ''))) // length('{q}') + (length(hint) - length(replace(hint, '{q}', ''))) // length('{q}'), 5) + CASE WHEN contains(lower(source), '{q}') THEN 1.5 ELSE 0 END"
        )
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


_SHAPE = "['png', 'jpg', 'gif'][CAST(doc_id % 3 AS INT) + 1]"


@query(
    f"""SELECT doc_id, format, score FROM (SELECT doc_id, {_SHAPE} AS format, {_tag_sql(['src1', 'license', 'the'])} AS score FROM (SELECT *, {_TAGS} AS tags, lower(text) AS low, lower(string_split(text, chr(10))[1]) AS hint FROM documents))
    WHERE score > 0 AND format IN ('png', 'gif') ORDER BY score DESC, doc_id LIMIT 40"""
)
def tag_search(t):
    """Documents as images: tags of their words, the first line as their description, three formats of which two are asked for."""
    tags = F.array_distinct(F.concat(F.array("lang", "source"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    kind = F.col("doc_id") % 3
    images = t("documents").withColumn("format", F.when(kind == 0, "png").when(kind == 1, "jpg").otherwise("gif"))
    columns = {"tags": tags, "source": F.col("source"), "title": F.col("lang"), "context": F.col("text"), "description": F.substring_index("text", "\n", 1), "name": F.col("source"), "format": F.col("format")}
    return S.tag_search(images, ["src1", "license", "the"], 40, "doc_id", columns, ["PNG", "gif"]).select("doc_id", "format", "score")


_Q = [round(((i * 37) % 19 - 9) / 50.0, 4) for i in range(64)]
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * {_Q}[i]))"


@query(f"SELECT vec_id, label, score FROM (SELECT vec_id, label, {_DOT} AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(t):
    return S.vector_topk(t("embeddings"), _Q, 20).select("vec_id", "label", "score")


_TEN = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0"
_PAIR = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(p.q[i] AS DOUBLE)))"


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT p.query_id, e.vec_id, {_PAIR} AS score FROM embeddings e CROSS JOIN ({_TEN}) p)) WHERE rank <= 5")
def vector_topk_many(t):
    e = t("embeddings")
    return S.vector_topk_many(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE)))) AS norm FROM embeddings")
def vector_norms(t):
    return t("embeddings").select("vec_id", S.norm(F.col("embedding")).alias("norm"))


_SUB = "(" + " + ".join(f"{1.5 if len(q) >= 4 else 1.0} * CASE WHEN contains(lower(text), '{q}') THEN 1.0 WHEN contains(lower(source), '{q}') THEN 0.7 ELSE 0 END" for q in ("license", "src1", "the")) + ") / 4.0"


@query(f"SELECT doc_id, CAST({_SUB} AS DOUBLE) AS keyword_score FROM documents")
def keyword_subscores(t):
    score = S.keyword_subscore(["license", "src1", "the"], F.col("text"), X.no_strings(), F.col("source"), F.lit(""))
    return t("documents").select("doc_id", score.alias("keyword_score"))


@query(
    f"""SELECT vec_id, vector_score, least(vector_score * 0.7 + kw * 0.3, 1.0) AS score FROM (SELECT vec_id, vector_score, CASE WHEN contains('label ' || label, '1') THEN 1.0 ELSE 0.0 END AS kw
    FROM (SELECT vec_id, label, {_DOT} AS vector_score FROM embeddings ORDER BY vector_score DESC, vec_id LIMIT 30)) ORDER BY score DESC, vec_id LIMIT 10"""
)
def hybrid_rerank(t):
    kw = S.keyword_subscore(["1"], F.concat(F.lit("label "), F.col("label")), X.no_strings(), F.lit(""), F.lit(""))
    return S.two_stage(t("embeddings"), _Q, kw, 10).select("vec_id", "vector_score", "score")


@query(
    f"""(SELECT 'documents' AS mode, doc_id AS id, score FROM (SELECT doc_id, CAST({_KEYWORD_SCORE} AS DOUBLE) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5)
    UNION ALL (SELECT 'benchmark' AS mode, item_id AS id, score FROM (SELECT item_id, CAST({_KEYWORD_SCORE} AS DOUBLE) AS score FROM benchmark) WHERE score > 0 ORDER BY score DESC, item_id LIMIT 5)"""
)
def multi_corpus_search(t):
    a = S.keyword_search(t("documents"), TERMS, 5, "doc_id", None, F.col("text")).select(F.lit("documents").alias("mode"), F.col("doc_id").alias("id"), "score")
    b = S.keyword_search(t("benchmark"), TERMS, 5, "item_id", None, F.col("text")).select(F.lit("benchmark").alias("mode"), F.col("item_id").alias("id"), "score")
    return a.unionByName(b)


@query(
    """WITH r AS (SELECT query, source AS file, lang AS title, 1 AS slide_num, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) ELSE '' END AS text_preview, n / (1.0 + n_chars) AS score, '/' || doc_id AS path_abs
        FROM (SELECT *, (length(text) - length(replace(text, query, ''))) // length(query) AS n FROM documents, (SELECT unnest(['der ', 'the ', 'que ']) AS query)) WHERE n > 0)
    SELECT query, CAST(place AS INT) AS place, file, title, CAST(slide_num AS BIGINT) AS slide_num, text_preview, CAST(score AS DOUBLE) AS score, path_abs FROM
    (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file, title, slide_num, text_preview, path_abs) AS place FROM r) WHERE place <= 15"""
)
def plugged_ranking(t):
    """A ranking function of a user's own: how often a text has the query for its length; it leaves fields out that have defaults."""

    def density(query: str, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            if n := r["text"].count(query):
                out.append({"file": r["source"], "title": r["lang"], "score": n / (1.0 + r["n_chars"]), "path_abs": f"/{r['doc_id']}"} | ({"text_preview": r["text"][:20]} if r["doc_id"] % 2 == 0 else {"slide_num": None}))
        return out

    return K.ranked(t("documents"), ["der ", "the ", "que "], density, 15)


_CAND = """SELECT p_partkey, p_brand, p_type, w, h, rel, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'ok' END AS tier FROM (SELECT *, CAST(p_size * 40 AS INT) AS w, CAST(p_partkey % 900 AS INT) AS h,
    (CASE WHEN contains(lower(p_name || ' ' || p_type), 'red') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'widget') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'economy') THEN 1 ELSE 0 END) / 3.0 AS rel FROM part)"""
_SCORE = "CASE WHEN tier IS NOT NULL AND rel > 0 THEN rel * 10000.0 + CASE WHEN w > 0 AND h > 0 AND w > h THEN 1000.0 ELSE -250.0 END - CASE WHEN w < 800 THEN 500.0 ELSE 0 END + least(greatest(w, 0) * greatest(h, 0) / 1000.0, 5000.0) END"


def _candidates(t):
    w, h = (F.col("p_size") * 40).cast("int"), (F.col("p_partkey") % 900).cast("int")
    tier = F.when(F.col("p_partkey") % 7 != 0, "ok")
    score = S.candidate_score("red widget economy", ["red", "widget", "economy"], tier, F.col("p_name"), F.col("p_type"), w, h, "landscape", 800)
    return t("part").select("p_partkey", "p_brand", S.relevance(["red", "widget", "economy"], F.col("p_name"), F.col("p_type")).alias("rel"), score.alias("score"), w.alias("w"), h.alias("h"))


@query(f"SELECT p_partkey, rel, CAST({_SCORE} AS DOUBLE) AS score FROM ({_CAND})")
def candidate_scores(t):
    return _candidates(t).select("p_partkey", "rel", "score")


@query(f"SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM (SELECT *, {_SCORE} AS score FROM ({_CAND})) WHERE score IS NOT NULL) WHERE rank <= 8")
def candidate_rank(t):
    rows = _candidates(t).where("score is not null")
    return S.ranked(rows, ["p_brand"], [F.desc("score"), F.col("p_partkey")]).where("rank <= 8").select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT p_brand, p_partkey FROM (SELECT *, max(CASE WHEN h > w THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS any_match FROM ({_CAND})) WHERE h > w OR any_match = 0")
def orientation_fallback(t):
    return S.filter_with_fallback(_candidates(t), "p_brand", F.col("h") > F.col("w")).select("p_brand", "p_partkey")


@query(
    """SELECT item_id, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM (
    SELECT b.item_id, d.doc_id, count(*) / any_value(b.n) AS score FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tok FROM documents) d
    JOIN (SELECT item_id, len(x) AS n, unnest(x) AS tok FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM benchmark)) b USING (tok) GROUP BY b.item_id, d.doc_id)) WHERE r = 1"""
)
def search_to_fill(t):
    """The best document for each item by the share of its tokens."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("words")
    return S.best_text_for(t("documents").select("doc_id", words), t("benchmark").select("item_id", words), "doc_id", "item_id", "words")


@query(f"SELECT array_to_string(list(doc_id ORDER BY score DESC, doc_id), ',') AS merged FROM (SELECT doc_id, {_KEYWORD_SCORE} AS score FROM documents) WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, {_KEYWORD_SCORE} AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10)")
def search_and_merge(t):
    top = S.keyword_search(t("documents"), TERMS, 10, "doc_id", None, F.col("text"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id")))
    return top.agg(F.array_join(F.transform(entries, lambda e: e["doc_id"].cast("string")), ",").alias("merged"))


@query()
def text_embedding(t):
    return t("benchmark").select("item_id", S.hashed_embedding(X.content_tokens(F.col("text"))).alias("embedding"))
