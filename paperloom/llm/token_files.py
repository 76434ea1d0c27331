"""Token ids as flat binary files with 64-bit offsets, written in id order and read by memory map.

Format, for each part of a set in the shared folder:

* ``part-NNNNN.bin``: the ids of the part's documents end to end, little-endian unsigned integers
  of 16 bits where the vocabulary allows it, else 32;
* ``part-NNNNN.idx``: n + 1 little-endian unsigned 64-bit offsets, in ids, from the part's start;
* ``part-NNNNN.ids``: n little-endian signed 64-bit document ids (with a null flag in ``.nul``, a
  byte a document);
* ``manifest.json``: type, end id, and of each part its documents, ids and *base*: the ids of all
  parts before it, a prefix sum over the parts' totals.

Documents are range-partitioned and sorted by id, so the parts in order are the corpus in order. A
task writes under a name of its own attempt and renames when done: an attempt that is repeated after
a lost executor replaces its part by the same bytes, and an unfinished one leaves no part. Texts are
encoded by way of their words: a worker keeps the ids of the words it has met in flat arrays of bounded size
and a slice of texts is one gather from them; nothing but the open slice is held in memory.

Null text: as empty, only the end id. Null doc_id: first in order; negative ones before others. Repeated ids:
in order of their texts' bytes; repeated rows: each is written. Very long texts: written in chunks. Empty
table: no parts. Extra columns: ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LARGE_CHUNK, Runs, shared_dir, slices, word_chunks
from .pre_tokens import PreTokens, load

READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
PART_SCHEMA = "part int, n_docs long, n_tokens long"


#: Words and ids that a worker remembers, some 200 MB; it starts anew beyond.
CACHE_WORDS, CACHE_IDS = 1 << 20, 1 << 23
_WORD_IDS: dict = {}


def word_ids(tokenizer_file: str, kind: str) -> Runs:
    """word -> its ids, through the library once while remembered; the worker's own, kept from task to task."""
    if (tokenizer_file, kind) not in _WORD_IDS:
        pre = PreTokens(tokenizer_file)

        def make(words: list[bytes]) -> list[list[int]]:
            split = [pre.split(w) for w in words]
            known = {p: pre.ids(p) for p in {p for s in split if s for p in s}}
            return [pre.whole(w) if s is None else known[s[0]] if len(s) == 1 else [i for p in s for i in known[p]] for w, s in zip(words, split, strict=True)]

        _WORD_IDS[tokenizer_file, kind] = Runs(make, kind, CACHE_WORDS, CACHE_IDS)
    return _WORD_IDS[tokenizer_file, kind]


def encoded(texts: pa.Array, runs: Runs, end_id: int):
    """(ids, ends): the ids of all texts in order, each with the end id, in parts; and the places in the part where texts end."""
    for words in word_chunks(texts, lower=False, most=LARGE_CHUNK):
        ids, length = runs.numbers(runs.places(words))
        if not words.ends:
            yield ids, np.zeros(0, np.int64)
            continue
        sizes = np.bincount(words.owner - words.first_row, length, words.rows).astype(np.int64)
        ends = np.cumsum(sizes)
        yield np.insert(ids, ends, end_id), ends + np.arange(1, words.rows + 1)


def local_path(uri: str) -> str:
    """The path of a shared folder as the file system mounts it; memory maps need a mounted one."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"token files are memory-mapped and need a mounted folder, not {uri}")
    return uri


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes the whole table's ids under ``folder`` and returns the manifest."""
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    kind = "<u2" if load(tokenizer_file).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(batches):
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = {k: f"{folder}/.part-{part:05d}.{attempt}.{k}" for k in ("bin", "idx", "ids", "nul")}
        files = {k: open(v, "wb") for k, v in names.items()}
        runs, at, docs_here = word_ids(tokenizer_file, kind), 0, 0
        files["idx"].write(np.zeros(1, "<u8").tobytes())
        for batch in slices(batches):
            for found, ends in encoded(batch.column(1), runs, end_id):
                files["bin"].write(found.data)
                files["idx"].write((at + ends).astype("<u8").tobytes())
                at += len(found)
            ids = batch.column(0)
            docs_here += len(ids)
            files["ids"].write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            files["nul"].write(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
        for k, f in files.items():
            f.close()
            if docs_here:
                os.replace(names[k], f"{folder}/part-{part:05d}.{k}")
            else:
                os.remove(names[k])
        if docs_here:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs_here], pa.int64()), pa.array([at], pa.int64())], ["part", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # by the start of the text too: one id may have many rows
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    parts, base = [], 0
    for r in sorted(ordered.mapInArrow(run, PART_SCHEMA).collect()):  # one row for each part
        parts.append({"part": r.part, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": base})
        base += r.n_tokens
    manifest = {"dtype": kind, "end_id": end_id, "n_tokens": base, "parts": parts}
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump(manifest, f)
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of a set: where its ids start in the corpus, their number and crc32."""
    folder = local_path(folder)
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    kind = manifest["dtype"]

    def run(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{folder}/part-{part:05d}"
                data, offsets = np.memmap(f"{name}.bin", kind, "r"), np.memmap(f"{name}.idx", "<u8", "r")
                ids, null = np.memmap(f"{name}.ids", "<i8", "r"), np.memmap(f"{name}.nul", "u1", "r")
                for low in range(0, len(ids), 10_000):
                    cut = offsets[low : low + 10_001].astype(np.int64)
                    crc = [zlib.crc32(data[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(ids[low : low + 10_000]), pa.int64(), mask=np.array(null[low : low + 10_000], bool)), pa.array(base + cut[:-1], pa.int64()), pa.array(cut[1:] - cut[:-1], pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = spark.createDataFrame([(p["part"], p["base"]) for p in manifest["parts"]], "part int, base long")
    return parts.repartition(max(1, len(manifest["parts"]))).mapInArrow(run, READ_SCHEMA)


def write_and_read(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Writes a set of files into the shared folder and reads it back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_file, end_id)
    return read_token_files(spark, folder)
