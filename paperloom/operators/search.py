"""Keyword, tag, vector and hybrid search, and ranking of candidates.

Searches keep one row for each hit and cut by ``orderBy().limit(k)``, which Spark plans as a partial
top-k in each task and a merge of k rows a task. Every order ends with a key, so ties have one result.
Queries are few and come as literals or as a small table; for many queries at once the best k of each are
kept by an aggregate that folds on the map side, never by sorting a query's hits in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def keyword_score(words: Column | None, text: Column, terms: list[str]) -> Column:
    """Of each term 2 if a keyword has it, else 1 if the text has it; over twice the number of terms.

    Without ``words`` the keywords are all of the text's words between spaces: one of them has a term without a space exactly if the text has it, so no array of them is made.
    """
    total = F.lit(0)
    low = F.lower(text)
    for term in terms:
        there = low.contains(term)
        keyword = F.exists(words, _contains(term)) if words is not None else F.lit(False) if " " in term else there
        total = total + F.when(keyword, 2).when(there, 1).otherwise(0)
    return total / (2.0 * len(terms))


def _contains(term: str):
    return lambda w: F.lower(w).contains(term)


def keyword_search(items: DataFrame, terms: list[str], k: int, key: str, words: Column | None, text: Column) -> DataFrame:
    """The k items of the highest keyword score over 0; ties by key."""
    scored = items.withColumn("score", keyword_score(words, text, terms)).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def tag_score(tags: Column, source: Column, title: Column, context: Column, name: Column, tokens: list[str], description: Column | None = None) -> Column:
    """Of each token: 3 for a tag that has it or is in it, 2 for the source, 2 for the title, its occurrences in context and description together up to 5, 1.5 for the name. Nulls are empty."""
    total = F.lit(0.0)
    source, title, context, name, description = (F.coalesce(c, F.lit("")) for c in (source, title, context, name, F.lit("") if description is None else description))
    for q in tokens:
        total = (
            total
            + F.when(F.exists(tags, _either(q)), 3.0).otherwise(0.0)
            + F.when(F.lower(source).contains(q), 2.0).otherwise(0.0)
            + F.when(F.lower(title).contains(q), 2.0).otherwise(0.0)
            + F.least(X.occurrences(F.lower(context), F.lit(q)) + X.occurrences(F.lower(description), F.lit(q)), F.lit(5))
            + F.when(F.lower(name).contains(q), 1.5).otherwise(0.0)
        )
    return total


def tag_search(images: DataFrame, tokens: list[str], k: int, key: str, columns: dict[str, Column], formats: list[str] | None = None) -> DataFrame:
    """The k images of the highest tag score over 0, of the given formats only; ties keep the key's order. ``columns``: tags, source, title, context, description, name, and format."""
    c = columns
    rows = images if formats is None else images.where(F.lower(c["format"]).isin([f.lower() for f in formats]))
    score = tag_score(c["tags"], c["source"], c["title"], c["context"], c["name"], [q.lower() for q in tokens], c["description"])
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def _either(q: str):
    return lambda t: t.contains(q) | F.lit(q).contains(t)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))


def vector_topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of the highest inner product with one query, exactly."""
    scored = vectors.withColumn("score", dot(F.col(vector), F.lit(query)))
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Queries that are sent to all tasks at once.
QUERY_BLOCK = 4096


#: Scores that a task has at once.
PRODUCT = 1 << 22


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row, in order, ties by id: a partial selection, and a sort of what is over or at its last value."""
    if scores.shape[1] > 4 * k:
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        wanted = scores >= last
        width = int(wanted.sum(1).max())  # more than k if some tie
        at = np.argsort(~wanted, axis=1, kind="stable")[:, :width]
        scores, ids = np.where(np.take_along_axis(wanted, at, 1), np.take_along_axis(scores, at, 1), -np.inf), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def vector_topk_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k of each of a set of queries.

    Queries go out in blocks of about ``block``, each against all vectors in one pass: a batch of vectors is one matrix
    product with the block, of which the task keeps the best k of each query so far. Then k rows a query and
    task are shuffled, whatever the table's size, and merged. Ties go to the lowest key.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for part in range(blocks):
        some = queries.select(F.col(query_key).cast("long"), F.col(query_vector)).where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == part).toArrow()
        names = some.column(0).to_numpy()
        rows = np.array(some.column(1).to_pylist(), float)
        sent = vectors.sparkSession.sparkContext.broadcast((names, rows))

        def run(batches, sent=sent):
            names, rows = sent.value
            if not len(names):
                return
            best, ids = np.full((len(names), 0), -np.inf), np.zeros((len(names), 0), np.int64)
            # as many vectors at once as make a product of a fixed size
            step = max(k, PRODUCT // len(names))
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    own, matrix = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    score = rows @ matrix.astype(float, copy=False).T
                    if best.shape[1] >= k:  # only what beats the last of a query's best, or ties with it
                        some = (score >= best[:, -1:]).any(0)
                        score, own = score[:, some], own[some]
                    best, ids = np.concatenate([best, score], 1), np.concatenate([ids, np.broadcast_to(own, score.shape)], 1)
                    best, ids = _best(best, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids.ravel()), pa.array(best.ravel())], ["q", "v", "s"])

        found = vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, "q long, v long, s double")
        out = found if out is None else out.union(found)
    merged = out.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "v"))), 1, k).alias("best"))
    return merged.select(F.col("q").alias(query_key), F.posexplode("best").alias("rank", "hit")).select(query_key, F.col("hit.v").alias(key), (-F.col("hit.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


#: Items that :func:`best_text_for` sends to all tasks at once, in bytes of their words.
ITEM_BYTES = 64 << 20


def best_text_for(texts: DataFrame, items: DataFrame, key: str, item_key: str, words: str, block: int = ITEM_BYTES) -> DataFrame:
    """(item_key, key, score): for each item the text with the largest share of the item's distinct words; ties to the lowest key.

    ``words`` names the array of distinct words in both. Items' words go to all tasks in blocks of about ``block`` bytes, each in one pass over the texts, as many as it takes: a task keeps
    the best text of each item of the block so far, and one row an item and task is shuffled. No word pairs rows, however frequent. The overlaps of a batch of texts with the
    block's items are one sparse product. Items no word of which occurs are left out; so are items without words.
    """
    size = items.agg(F.sum(F.expr(f"aggregate({words}, 0L, (n, w) -> n + octet_length(w))"))).first()[0] or 0
    blocks, out = max(1, -(-size // block)), None
    for part in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == part).select(F.col(item_key).cast("long"), words).toArrow()
        found_words = [w or () for w in rows.column(1).to_pylist()]
        owners: dict[str, list[int]] = {}
        for at, own in enumerate(found_words):
            for w in own:
                owners.setdefault(w, []).append(at)
        lengths = np.array([len(x) for x in owners.values()], np.int64)
        index = ({w: n for n, w in enumerate(owners)}, np.concatenate([np.zeros(0, np.int64), *map(np.array, owners.values())]).astype(np.int64), np.cumsum(lengths) - lengths, lengths)
        sent = texts.sparkSession.sparkContext.broadcast((*index, rows.column(0).to_numpy(), np.array([max(1, len(w)) for w in found_words], float)))

        def run(batches, sent=sent):
            number, of, begin, length, names, sizes = sent.value
            best, ids = np.zeros(len(names)), np.zeros(len(names), np.int64)
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    texts_ = batch.slice(low, 256)
                    keys = texts_.column(0).to_numpy()
                    lists = texts_.column(1)
                    flat = np.fromiter((number.get(w, -1) for w in lists.flatten().to_pylist()), np.int64)
                    row = np.repeat(np.arange(len(keys)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                    row, flat = row[flat >= 0], flat[flat >= 0]
                    many = length[flat]
                    at = np.repeat(begin[flat] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    pair, hits = np.unique(np.repeat(row, many) * len(names) + of[at], return_counts=True)
                    item, own = pair % max(1, len(names)), keys[pair // max(1, len(names))]
                    score = hits / sizes[item]
                    first = np.lexsort((own, -score, item))
                    first = first[np.append(True, np.diff(item[first]) != 0)] if len(first) else first
                    item, own, score = item[first], own[first], score[first]
                    better = (score > best[item]) | ((score == best[item]) & (own < ids[item]))
                    best[item[better]], ids[item[better]] = score[better], own[better]
            at = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids[at]), pa.array(best[at])], ["i", "k", "s"])

        found = texts.select(F.col(key).cast("long"), words).mapInArrow(run, "i long, k long, s double")
        out = found if out is None else out.union(found)
    best = out.groupBy("i").agg(F.min(F.struct((-F.col("s")).alias("s"), "k")).alias("b"))
    return best.select(F.col("i").alias(item_key), F.col("b.k").alias(key), (-F.col("b.s")).alias("score"))


def keyword_subscore(tokens: list[str], text: Column, words: Column, title: Column, file: Column) -> Column:
    """Weighted share of tokens found: 1 in the text, else 0.8 in a keyword, 0.7 in the title, 0.5 in the file's name.

    A token of four or more characters weighs 1.5, others 1.
    """
    if not tokens:
        return F.lit(0.0)
    total, weights = F.lit(0.0), 0.0
    for q in tokens:
        w = 1.5 if len(q) >= 4 else 1.0
        weights += w
        hit = F.when(F.lower(text).contains(q), 1.0).when(F.exists(words, _contains(q)), 0.8).when(F.lower(title).contains(q), 0.7).when(F.lower(file).contains(q), 0.5).otherwise(0.0)
        total = total + hit * w
    return total / weights


def hybrid_score(vector: Column, keyword: Column, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> Column:
    return F.least(vector * vector_weight + keyword * keyword_weight, F.lit(1.0))


def two_stage(vectors: DataFrame, query: list[float], keyword: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best 3k by vector, ranked again by the hybrid score, cut to k. The first cut is part of the result."""
    first = vector_topk(vectors, query, 3 * k, key, vector).withColumnRenamed("score", "vector_score")
    return first.withColumn("score", hybrid_score(F.col("vector_score"), keyword)).orderBy(F.desc("score"), key).limit(k)


def relevance(tokens: list[str], title: Column, author: Column) -> Column:
    """Share of the query's tokens in title and author; 1 without tokens, 0 without text."""
    if not tokens:
        return F.lit(1.0)
    text = F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(author, F.lit(""))))
    hits = F.lit(0)
    for q in tokens:
        hits = hits + F.when(text.contains(q), 1).otherwise(0)
    return F.when(text == "", 0.0).otherwise(hits / float(len(tokens)))


#: Words of transport places, which lower a candidate unless the query names one.
INFRASTRUCTURE = ("station", "subway", "metro", "rail", "transit", "airport", "bus", "地铁", "站", "轨道")


def candidate_score(query: str, tokens: list[str], tier: Column, title: Column, author: Column, width: Column, height: Column, orientation: str | None = None, least_width: int = 0, least_height: int = 0) -> Column:
    """Higher is better; null rejects (no licence tier, or nothing of the query in the texts)."""
    rel = relevance(tokens, title, author)
    text = F.lower(F.concat_ws(" ", title, author))
    score = rel * 10000.0
    if not any(t in query.lower() for t in INFRASTRUCTURE):
        score = score - F.when(X.any_contained(text, INFRASTRUCTURE), 5000.0).otherwise(0.0)
    if orientation:
        score = score + F.when(X.orientation(width, height) == orientation, 1000.0).otherwise(-250.0)
    if least_width:
        score = score - F.when(width < least_width, 500.0).otherwise(0.0)
    if least_height:
        score = score - F.when(height < least_height, 500.0).otherwise(0.0)
    score = score + F.least(F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0)) / 1000.0, F.lit(5000.0))
    return F.when(tier.isNotNull() & (rel > 0), score)


def ranked(items: DataFrame, partition: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    from pyspark.sql import Window

    return items.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def filter_with_fallback(items: DataFrame, group: str, keep: Column) -> DataFrame:
    """The rows that match; of groups where none matches, all rows."""
    any_match = items.groupBy(group).agg(F.max(keep.cast("int")).alias("_any"))
    return items.join(any_match, group).where(keep | (F.col("_any") == 0)).drop("_any")


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """A unit vector from hashed token counts: the default text encoder, where no model's weights are at hand. One pass over the tokens' places."""

    @F.pandas_udf("array<double>")
    def unit(places: pd.Series) -> pd.Series:
        counts = [np.bincount(np.asarray(p if p is not None else (), np.int64), minlength=dim).astype(float) for p in places]
        return pd.Series([c / max(np.sqrt(c @ c), 1e-12) for c in counts])

    return unit(F.transform(F.coalesce(tokens, X.no_strings()), lambda x: F.pmod(F.xxhash64(x), F.lit(dim)).cast("int")))


def plugged_ranking(items: DataFrame, rank_rows, schema: str, k: int, order: list[Column]) -> DataFrame:
    """A user's ranking function over batches of rows (a pandas iterator), sorted and cut to k."""
    return items.mapInPandas(rank_rows, schema).orderBy(*order).limit(k)
