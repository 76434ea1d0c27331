"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversation_repair, decontaminate, language_id, license_scan, lm_scores, ngram_jaccard, quality_rules, sharding, token_counts, token_files, toxicity, vector_codes

#: Vocabulary files, by role; a caller may set others.
TOKEN_LIMIT = 2048
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), TOKEN_LIMIT)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", sharding.row_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_token_counts, op3_ngram_jaccard, op4_toxicity, op5_bpe_codec, op6_token_files, op7_quality_rules, op8_lm_scores, op9_license_scan, op10_sharding, op11_language_id, op12_conversation_repair, op13_vector_codes, pipeline)
    return {f.__name__: f for f in own}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(key: str, source: str, k: int) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s
        FROM (SELECT {key}, {_WORDS} AS w FROM {source})"""


_FLOOR_MEAN = "(s - ((s % n + n) % n)) // n"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain rounds over all pairs of parts and entries."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "SELECT vec_id, part, arg_min(e, d * {n} + e) AS e, min(d) AS d FROM (SELECT vec_id, part, e, {d} AS d FROM p JOIN c{k} USING (part)) GROUP BY ALL"
    sql = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, g AS part, v[g * len(v) // {parts} + 1:(g + 1) * len(v) // {parts}] AS x FROM k, range({parts}) r(g)),
        c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))"""
    for k in range(rounds):
        sql += f""", a{k} AS MATERIALIZED ({nearest.format(n=entries, d=distance, k=k)}),
        s{k} AS (SELECT part, e, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT a.part, a.e, p.x, unnest(range(1, len(p.x) + 1)) AS j FROM a{k} a JOIN p USING (vec_id, part)) GROUP BY ALL),
        c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT part, e, list(CAST({_FLOOR_MEAN} AS HUGEINT) ORDER BY j) AS c FROM s{k} GROUP BY ALL) m USING (part, e))"""
    return (
        sql
        + f""", f AS ({nearest.format(n=entries, d=distance, k=rounds)}),
        r AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code, sum(d) AS error FROM f GROUP BY vec_id),
        l AS (SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label) AS label_error FROM r JOIN k USING (vec_id))
        SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(label_error AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256 FROM l"""
    )


#: CRC-32 of an ASCII string, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({0}, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"""


def _repair_sql() -> str:
    """A recursion over each conversation's rows that carries the cheapest (cost, audit, repaired rows) to each state."""
    edit = "{{'c': {s}.c + {cost}, 'a': {s}.a || '{e}', 't': {s}.t || {role} || ':' || {text} || chr(10)}}".format
    inserted = lambda s, role: edit(s=s, cost=2, e="I", role=f"'{role}'", text="''")
    stays = "fault IN (0, 3)"
    kept = lambda s, initial: f"CASE WHEN {stays} AND role[1] = '{initial}' THEN {edit(s=s, cost='cut', e='K', role='role', text='text')} END"
    changed = lambda s, role: f"CASE WHEN {stays} THEN {edit(s=s, cost='2 + cut', e='R', role=repr(role), text='text')} END"
    gone = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 3, 'a': {s}.a || 'D', 't': {s}.t}} END"
    # a way from a state that can't be reached is null
    least = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"
    users = [f(s, x) for s in ("s0", "s1", "a") for f, x in ((kept, "u"), (changed, "user"))]
    way = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_CRC.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM o, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        f AS MATERIALIZED (SELECT *, CASE fault WHEN 3 THEN 1 ELSE 0 END AS cut FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
            lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n)),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
            count_if(before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM f GROUP BY conv_id),
        w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 't': ''}} AS {way}) AS s0, CAST(NULL AS {way}) AS s1, CAST(NULL AS {way}) AS s2, CAST(NULL AS {way}) AS s3 FROM g
            UNION ALL SELECT conv_id, i, {gone("s0")}, {least(gone("s1"), kept("s0", "s"))}, {least(gone("u"), *users)}, {least(gone("a"), kept("u", "a"), changed("u", "assistant"))}
            FROM (SELECT *, {least("s3", inserted("u", "assistant"))} AS a FROM (SELECT f.*, s0, s1, s3, {least("s2", inserted("s0", "user"), inserted("s1", "user"), inserted("s3", "user"))} AS u
                FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
        e AS (SELECT g.*, {least("s0", "s3", inserted("s2", "assistant"))} AS best FROM g JOIN w ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.rows = w.i)
        SELECT c.conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x.split(".")[-1]}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
            CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[:-2], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_conversation_repair": _repair_sql(),
        "op13_vector_codes": _codes_sql(),
        "op1_decontaminate": f"""
            WITH d AS ({_shingles("doc_id", "documents", 5)}), b AS ({_shingles("item_id", "benchmark", 5)}),
            n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
            hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
            SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM hits JOIN n USING (item_id) WHERE n_shared * 100 >= 80 * n_item""",
        "op3_ngram_jaccard": f"""
            WITH RECURSIVE d AS ({_shingles("doc_id", "documents", 3)}),
            n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
            links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
                GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (max(p.n) + max(q.n) - count(*))),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
            SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)""",
    }
