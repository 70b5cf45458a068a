"""Append-only log files brought into a versioned target, run by run.

A run lists the files, compares them with the target's state (which keys it holds, read from the
narrow summaries, never from rows) and reads only what is new: whole files that are unseen, have shrunk
or went back in time, and else the bytes after the position (``sources.ranges``). A last line without
line break is left for a later run and takes no number. Rows, their keys and the retired keys of reread files become visible by one atomic
publish; a run that fails before it leaves nothing behind that a reader or the next run could see.

Defined cases. Empty files and files with an unfinished line only give no rows and no key. Bytes that
are no UTF-8 are replaced. A file rewritten at the same or a larger size with a later time is not
noticed, as its position still fits. Files that vanished keep their rows. No files: nothing is
published. Repeated folders are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.incremental import VersionedTarget
from threadlake.operators.maintain import scan_plan
from threadlake.sources.ranges import RANGE_BYTES, read_ranges
from threadlake.storage import materialize


def positions(target: VersionedTarget, version: int) -> DataFrame | None:
    """(path, size, mtime, offset, line_no): how far each file is loaded."""
    held = target.keys(version)
    if held is None:
        return None
    newest = F.max_by(F.struct("size", "mtime", F.col("loaded_to").alias("offset"), "line_no"), "loaded_to")
    return held.groupBy("path").agg(newest.alias("p")).select("path", "p.*")


def run(target: VersionedTarget, present: DataFrame, tombstones: DataFrame | None = None, range_bytes: int = RANGE_BYTES, before_publish=None) -> int:
    """Load what is new of the present files (path, size, mtime) and publish it; returns the version
    that holds it. Forgotten files (tombstones: path) are left out. before_publish is called when all
    is written and nothing is published yet."""
    spark, base = target.spark, target.version()
    if tombstones is not None:
        present = present.join(tombstones.select("path"), "path", "left_anti")
    seen = positions(target, base)
    if seen is None:
        seen = spark.createDataFrame([], "path string, size bigint, mtime double, offset bigint, line_no bigint")
    plan = scan_plan(seen, present).join(present, "path").join(seen.select("path", F.col("line_no").alias("__line")), "path", "left")
    plan = plan.filter("action <> 'skip'").select("path", "action", "size", "mtime", "from_offset", F.when(F.col("action") == "append", F.col("__line")).otherwise(0).alias("from_line"))
    plan, _ = materialize(plan, "plan")
    if not plan.limit(1).count():
        return base
    lines, _ = materialize(read_ranges(plan, range_bytes).filter("has_newline").drop("has_newline"), "lines")
    ends = lines.groupBy("path").agg(F.max("byte_end").alias("loaded_to"), F.max("line_no").alias("line_no"))
    key = F.concat("path", F.lit("@"), F.col("from_offset").cast("string"))
    version = F.concat_ws("/", F.col("size").cast("string"), F.col("mtime").cast("string"))
    keyed = plan.select("path", "size", "mtime", key.alias("source_key"), version.alias("source_version"))
    summary = keyed.join(ends, "path")
    retired = None
    held = target.keys(base)
    if held is not None:
        retired = held.select("path", "source_key").join(plan.filter("action = 'restart'").select("path"), "path", "left_semi").select("source_key")
        retired = retired.join(summary.select("source_key"), "source_key", "left_anti")
    if not lines.limit(1).count() and (retired is None or not retired.limit(1).count()):
        return base  # unfinished lines only
    if before_publish is not None:
        before_publish()
    rows = lines.join(keyed.select("path", "source_key", "source_version"), "path")
    return target.publish(rows, base, retired, summary)
