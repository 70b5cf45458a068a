"""A trigram index over blocks of rows, kept in a versioned target beside the rows.

A block is a stretch of at most ``BLOCK_ROWS`` rows. Its summary, published together with its rows,
holds the hashed trigrams that occur in its case-folded texts, its number of rows and the sum of
their lengths. A term can only occur in a block that has all its trigrams, so a search reads the
summaries, then only the blocks that can match, and there looks at the texts themselves: the result
is exact, hash collisions and trigrams of different rows only cost reading. Corpus statistics come
from the summaries. Rows are added block by block, as a new version; blocks can be retired.

Defined cases. Null texts have no trigrams and length 0. Terms of less than three characters can't
be looked up: a query of such alone reads every block. Without a published version nothing matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.operators import search
from threadlake.operators.incremental import VersionedTarget
from threadlake.storage import materialize

BLOCK_ROWS = 50_000
#: Buckets that trigrams are hashed into.
BUCKETS = 1 << 18
#: Candidate blocks up to which the scan is filtered by their names; beyond, by a join.
MOST_NAMES = 10_000

SUMMARY = pa.schema([("source_key", pa.string()), ("grams", pa.list_(pa.int32())), ("n_rows", pa.int64()), ("length", pa.int64())])
SUMMARY_DDL = "source_key string, grams array<int>, n_rows bigint, length bigint"


def buckets(text: str) -> np.ndarray:
    """Hashed trigrams of a text, with repetitions."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((x ^ (x >> np.uint64(15))) * np.uint64(0xC2B2AE3D) >> np.uint64(11)) % np.uint64(BUCKETS) if len(c) > 2 else np.zeros(0, np.uint64)


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, case-folded text, length) to summaries; a block may give several, each of some rows."""
    held: dict[str, list] = {}
    for b in batches:
        keys = b.column(0).dictionary_encode()
        codes = keys.indices.to_numpy()
        for k, name in enumerate(keys.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == k)
            own = held.setdefault(name, [np.zeros(BUCKETS, bool), 0, 0])
            own[0][buckets("\x00".join(t for t in b.column(1).take(pa.array(rows)).to_pylist() if t)).astype(np.int64)] = True
            own[1] += len(rows)
            own[2] += int(b.column(2).to_numpy()[rows].sum())
    names = list(held)
    grams = pa.array([np.flatnonzero(held[n][0]).astype(np.int32) for n in names], SUMMARY.types[1])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), grams, pa.array([held[n][1] for n in names], pa.int64()), pa.array([held[n][2] for n in names], pa.int64())], schema=SUMMARY)


def add(target: VersionedTarget, rows: DataFrame, text: str = "text", block_rows: int = BLOCK_ROWS, retired: DataFrame | None = None) -> int:
    """Publish rows as new blocks of the target; returns the version. retired: source keys of blocks
    that no longer count."""
    place = F.monotonically_increasing_id()
    block = F.concat_ws("-", F.lit(uuid.uuid4().hex), F.shiftright(place, 33), F.floor(place.bitwiseAND((1 << 33) - 1) / block_rows))
    blocks, _ = materialize(rows.withColumn("source_key", block).withColumn("source_version", F.lit(1).cast("bigint")), "blocks")
    length = F.greatest(F.length(F.coalesce(text, F.lit(""))) - 2, F.lit(0)).cast("bigint")
    summary = blocks.select("source_key", F.lower(text), length).mapInArrow(_summarize, SUMMARY_DDL).withColumn("source_version", F.lit(1).cast("bigint"))
    return target.publish(blocks, target.version(), retired, summary)


def candidates(summary: DataFrame, terms: list[str]) -> DataFrame:
    """(source_key) of the blocks in which at least one of the terms can occur."""
    out = F.lit(False)
    for t in terms:
        wanted = sorted(set(buckets(t.lower()).tolist()))
        every: Column = F.lit(True)
        for g in wanted:
            every = every & F.array_contains("grams", F.lit(int(g)))
        out = out | every
    return summary.filter(out).select("source_key").distinct()


def matches(target: VersionedTarget, query: str, extra: Column | None = None) -> DataFrame | None:
    """``search.matches`` over the target's rows, reading only the blocks that can match."""
    version = target.version()
    rows, summary = target.read(version), target.keys(version)
    if rows is None:
        return None
    long, _ = search.split_terms(query)
    if not long:
        return search.matches(rows, query, extra)
    names, _ = materialize(candidates(summary, long), "candidates")
    few = [r[0] for r in names.limit(MOST_NAMES + 1).collect()]
    read = rows.filter(F.col("source_key").isin(few)) if len(few) <= MOST_NAMES else rows.join(names, "source_key", "left_semi")
    corpus = summary.agg(F.sum("n_rows").alias("__rows"), (F.sum("length") / F.sum("n_rows")).alias("__mean"))
    return search.matches(read, query, extra, corpus).drop("source_key", "source_version")
