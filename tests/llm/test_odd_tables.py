"""Sharding of tables whose columns have the operator's own names, and encoding of odd ids in small slices."""

from collections import Counter

import public_tokenizers

from paperloom.llm import bpe_codec, sharding

NAMES = ["_shard_to", "_shard_bits", "_shard_hash", "_shard_id", "_shard_of", "_shard_bin", "_shard_sub", "_shard_rank", "_shard_base", "_shard_row", "h", "d", "size", "entry", "a.b", "slot"]


def test_any_names_of_columns(spark):
    rows = [(i, f"text {i % 40}", *(f"{n}{i}" for n in range(len(NAMES)))) for i in range(300)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *NAMES])
    got = sharding.shard(df, shards=5)
    kept = [c for c in df.columns if c != "slot"]
    assert got.columns == [*kept, "shard", "slot"]
    assert Counter(tuple(r)[:-2] for r in got.collect()) == Counter(r[:-1] for r in rows)


def test_ids_and_copies_are_encoded_each(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(None, "a b"), (-5, "a b"), (7, None), (7, ""), (7, ""), (1 << 62, "é " * 400)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = bpe_codec.encode_decode(df, path, public_tokenizers.PATTERN).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.n_tokens for r in got if r.doc_id == 7} == {0} and len({r.ids_sha256 for r in got if r.doc_id in (None, -5)}) == 1
    assert bpe_codec.encode_decode(df.where("false"), path, public_tokenizers.PATTERN).count() == 0
