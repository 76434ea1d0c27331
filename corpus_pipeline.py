"""A corpus through five operators of the llm subpackage; each stage is written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The last one
returns a row of digests for each document; the others return the columns of documents, whatever else they are called.

What stays: a null or empty text is scored by the toxicity model's bias, and goes at the quality rules (under 20 words).
Null, negative and repeated ids take part by their own texts; only the near-copy stage folds rows, to one for each group
(the lowest id; of rows that repeat id and text, one), and labels that stand on a repeated id teach by one of its rows. Very long
texts are judged whole. Ties of a near-copy group go to the lowest id, then the lowest digest. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe_codec, decontaminate, ngram_jaccard, quality_rules, toxicity
from paperloom.llm._common import release, shared_dir, tables_of
from paperloom.llm.queries import pattern, table, vocabulary

#: Near copies, as stages on word shingles take them: five words, and a similarity of 0.8 or more.
COPY_WORDS, COPY_PERCENT = 5, 80

#: Tables of the pipeline's own stage before, whose result is stored when the next one begins.
_BEFORE: list[str] = []


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, _BEFORE)
    with tables_of(_BEFORE):
        return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, _BEFORE)
    with tables_of(_BEFORE):
        return quality_rules.drop_failed(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, _BEFORE)
    with tables_of(_BEFORE):
        return ngram_jaccard.one_of_each_group(docs, k=COPY_WORDS, percent=COPY_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, _BEFORE)
    with tables_of(_BEFORE):
        return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark, _BEFORE)
    with tables_of(_BEFORE):
        return bpe_codec.encode_decode(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding and decoding", encode),
]

#: Trained stages are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each wrote is deleted once the next one's result is stored."""
    docs, stored = table(spark, sf_dir, "documents"), []
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        release(spark, stored)
        stored.append(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    release(spark, _BEFORE)
    return docs
