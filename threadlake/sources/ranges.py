"""Lines of text files read in byte ranges: no file is one row, and none is one task's work.

A range owns the lines that begin in it. Where a file has several ranges, line breaks are counted
first, so that every range knows its first line's number; no line is ever shuffled. Only a line break
ends a line; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.storage import materialize

#: Bytes of a file that one task reads, and that it holds at once.
RANGE_BYTES = 64 << 20
BUFFER_BYTES = 4 << 20
#: Rows of an emitted batch, at most.
BATCH_LINES = 10_000

LINES = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("raw", pa.string()), ("has_newline", pa.bool_())])
LINES_DDL = "path string, line_no bigint, byte_start bigint, byte_end bigint, raw string, has_newline boolean"


def listing(spark: SparkSession, globs: list[str]) -> DataFrame:
    """(path, size, mtime) of the files, without reading them."""
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(globs)))
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def byte_ranges(plan: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, begin, start, end, from_line) of the ranges of files to read: plan has path,
    size, from_offset, from_line."""
    last = F.floor((F.col("size") - 1 - F.col("from_offset")) / range_bytes)
    rows = plan.filter("size > from_offset").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("from_offset") + F.col("k") * range_bytes
    return rows.select("path", "size", F.col("from_offset").alias("begin"), start.alias("start"), F.least(start + range_bytes, F.col("size")).alias("end"), "from_line")


def _open(path: str):
    from pyarrow import fs  # noqa: PLC0415

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + "/" + path.removeprefix("file:").lstrip("/"))
    return system.open_input_file(inner)


def _blocks(file, start: int, end: int) -> Iterator[bytes]:
    file.seek(start)
    while start < end:
        block = file.read(min(BUFFER_BYTES, end - start))
        if not block:
            return
        start += len(block)
        yield block


def _count_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, n): lines that begin in the range."""
    for b in batches:
        n = []
        for path, begin, start, end in zip(*[b.column(k).to_pylist() for k in range(4)]):
            with _open(path) as f:
                n.append((start == begin) + sum(x.count(b"\n") for x in _blocks(f, max(start - 1, begin), end - 1)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["path", "start", "n"])


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the ranges (path, size, begin, start, end, lines above)."""
    for b in batches:
        for path, size, begin, start, end, number in zip(*[b.column(k).to_pylist() for k in range(6)]):
            held: list[tuple] = []
            with _open(path) as f:
                at = start if start == begin else start - 1
                skip, tail, head = start != begin, [], at  # tail: the pieces of the line that begins at head
                for block in _blocks(f, at, size):
                    cut = 0
                    while True:
                        stop = block.find(b"\n", cut)
                        if stop < 0:
                            if not skip:
                                tail.append(block[cut:])
                            break
                        after = at + stop + 1
                        if skip:
                            skip = False
                        else:
                            number += 1
                            held.append((number, head, after, (b"".join(tail) + block[cut:stop]).decode("utf-8", "replace"), True))
                            tail = []
                        head, cut = after, stop + 1
                        if head >= end:
                            break
                    at += len(block)
                    if len(held) >= BATCH_LINES:
                        yield _batch(path, held)
                        held = []
                    if head >= end:
                        break
            if not skip and head < end and any(tail):
                held.append((number + 1, head, size, b"".join(tail).decode("utf-8", "replace"), False))
            if held:
                yield _batch(path, held)


def _batch(path: str, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), *[pa.array(x, t) for x, t in zip(zip(*held), LINES.types[1:])]], schema=LINES)


def read_ranges(plan: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, line_no, byte_start, byte_end, raw, has_newline) of the lines of the planned files; a last
    line without line break has has_newline false."""
    spark = plan.sparkSession
    ranges, _ = materialize(byte_ranges(plan, range_bytes), "ranges")
    several = ranges.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path")
    many = ranges.join(several, "path", "left_semi")
    counts = many.select("path", "begin", "start", "end").mapInArrow(_count_starts, "path string, start bigint, n bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    placed = ranges.join(base, ["path", "start"], "left").select("path", "size", "begin", "start", "end", (F.col("from_line") + F.coalesce("above", F.lit(0))).alias("number"))
    cores = spark.sparkContext.defaultParallelism
    return placed.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start").mapInArrow(_read_ranges, LINES_DDL)
