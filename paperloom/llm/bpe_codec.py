"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before they reach the library, at *safe boundaries*: a point between a word
character and a single space followed by a word character. Every match of the splitting pattern that
starts at such a space starts there in the whole text too, so the ids are those of the whole text.
A run of white space longer than the library's regular-expression engine can backtrack over is cut
out by rule: of a run of n characters before other text, the first n - 1 are one match; at the end
of the text all n are.

Null text: as empty. Empty text: no ids. Null, negative and wide ids: carried as they are. Repeated ids or rows: each is encoded, so
there are no ties to settle. Very long texts: whole, ``ROWS`` texts of a batch at a time. Empty table: no rows. Extra columns, whatever their names: ignored, as every function returns its own columns only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

#: Characters after which a long text is cut at the next safe boundary.
CHUNK = 1 << 16
#: Texts that a worker unpacks at once.
ROWS = 64
#: The white space of the pattern's ``\s`` (Unicode White_Space), as a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
LONG_SPACE = re.compile(f"[{SPACE}]{{2000,}}")
SAFE = re.compile(r"(?<=\w)(?= \w)")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def load(rank_file: str, pattern: str):
    """The library's encoding for a rank file; kept for the life of the worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """(part, is one match) of a text, cut at safe boundaries; parts join to the text."""
    if len(text) <= 2000:
        yield text, False
        return
    at = 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield from _cut(text[at : run.start()], chunk)
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield from _cut(text[at:], chunk)


def _cut(text: str, chunk: int) -> Iterator[tuple[str, bool]]:
    at = 0
    while len(text) - at > chunk:
        found = SAFE.search(text, at + chunk)
        if not found:
            break
        yield text[at : found.start()], False
        at = found.start()
    yield text[at:], False


def encode(encoding, text: str | None, chunk: int = CHUNK) -> list[int]:
    """The ids of a whole text, without special tokens."""
    out: list[int] = []
    for part, single in pieces(text or "", chunk):
        out += encoding._encode_single_piece(part.encode()) if single else encoding.encode_ordinary(part)
    return out


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the real ids, one row for each input row."""

    def run(batches):
        encoding = load(rank_file, pattern)
        for batch in slices(batches, ROWS):
            ids = [encode(encoding, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the raw bytes of each row of ids."""

    def run(batches):
        encoding = load(rank_file, pattern)
        for batch in slices(batches, ROWS):
            data = [encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes and digests each document in one narrow pass; no ids leave the worker."""

    def run(batches):
        encoding = load(rank_file, pattern)
        for batch in slices(batches, ROWS):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = encode(encoding, text)
                rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
