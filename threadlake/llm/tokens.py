"""Text sizes in tokens of a public byte-level BPE vocabulary (rank file of base64 tokens), and an
identity of document rows that does not depend on how the table is split."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.storage import spread

#: Rank file; on a cluster, a path that every executor sees.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts were split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Equal rows that are numbered in one place; more of them are dealt out to other tasks.
COPY_BLOCK = 10_000
#: What tells document rows apart: equal rows are numbered from 0.
IDENTITY = ["doc_id", "text_hash", "copy_no"]


def encoding(path: str):
    """The encoder of a rank file, read once per worker process."""
    import base64  # noqa: PLC0415

    import tiktoken  # noqa: PLC0415

    held = sys.__dict__.setdefault("_threadlake_encodings", {})
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def token_numbers(encode, texts: list) -> list[int]:
    """Tokens of each text; a null text has none."""
    return [len(encode(t)) if t else 0 for t in texts]


def counter(path: str):
    """Arrow batches of (id, hash, text) to (id, hash, n_tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(token_numbers(encode, b.column(2).to_pylist()), pa.int64())], schema=schema)

    return run


def keyed(documents: DataFrame, *more) -> DataFrame:
    """(doc_id, text_hash, text, more...) of every row, spread over the cores."""
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *more))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *[c for c in rows.columns if c != "doc_id"])


def numbered(rows: DataFrame, more: list | None = None) -> DataFrame:
    """rows (all of whose columns tell rows apart) with ``copy_no``, the number of a row among
    equal ones. Equal rows are counted, partial counts first, and written out again in blocks, so
    neither a row that is most of the table nor the way it is split matters. more are aggregates
    to carry along."""
    counts = rows.groupBy(*[c for c in rows.columns if c not in [n for n, _ in more or []]]).agg(F.count(F.lit(1)).alias("__m"), *[a.alias(n) for n, a in more or []])
    few = counts.filter(F.col("__m") <= COPY_BLOCK).withColumn("__b", F.lit(0).cast("bigint"))
    many = counts.filter(F.col("__m") > COPY_BLOCK).withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__m") - 1) / COPY_BLOCK)).cast("array<bigint>")))
    blocks = few.unionByName(many.repartition("doc_id", "text_hash", "__b"))
    first = F.col("__b") * COPY_BLOCK
    return blocks.withColumn("copy_no", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("__m")) - 1))).drop("__m", "__b")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text_hash, n_tokens, copy_no): one row per row of documents."""
    return numbered(keyed(documents).select("doc_id", "text_hash", "text").mapInArrow(counter(tokenizer), "doc_id bigint, text_hash bigint, n_tokens bigint"))
