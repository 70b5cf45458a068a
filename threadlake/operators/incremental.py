"""Problem 2: process only what was added or changed since the last run that ended well.

The target is the state. Every row of it carries the source key and the source version it came
from; pending rows are the source anti-joined against that. A new target version is a folder of
its own, made visible by one atomic rename of a small manifest: a run that fails before leaves the
target as it was (its rows come again), one that fails after has published (they don't).

``pending_lines`` applies this to append-only logs, where a file's loaded lines are one range: the
target's rows are (file, version, loaded up to a byte), outdated versions are retired first, and
lines are anti-joined by file and byte range. Files are cut into ranges of ``CHUNK_BYTES``, so a
file that holds a third of all lines is spread over many keys.

Defined cases. Equal newest listings or positions: the one with the larger values counts. Null
paths, file ids and run ids match nothing; a null size, mtime or offset makes a position unusable,
so the file is read whole. Repeated rows of the bookkeeping tables change nothing. Lines of files
that are not listed are not on disk and never pending. Empty tables: no listing, no pending lines;
no position, all lines of listed files. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.storage import broadcast_if_bounded, hadoop_path, materialize, shared_dir

#: Schemes of stores without an atomic rename.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos"}

#: Bytes of a file that share one join key.
CHUNK_BYTES = 64 << 20


def present_files(file_listing: DataFrame) -> DataFrame:
    """(path, size, mtime): the newest listing of each path."""
    newest = F.max_by(F.struct("size", "mtime"), F.struct("listed_at", "mtime", "size"))
    return file_listing.filter("path is not null").groupBy("path").agg(newest.alias("s")).select("path", "s.size", "s.mtime")


def good_positions(files_seen: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """(path, pos_size, pos_mtime, pos_offset): each path's position from the last run that ended
    well. Runs are broadcast only if there are few."""
    ended_well = scan_runs.filter(F.lower("status") == "ok").select("run_id").distinct()
    seen = files_seen.filter("path is not null").join(broadcast_if_bounded(ended_well), "run_id", "left_semi")
    newest = F.max_by(F.struct("size", "mtime", "offset"), F.struct("run_id", "last_scan", "offset", "size", "mtime"))
    return seen.groupBy("path").agg(newest.alias("s")).select("path", F.col("s.size").alias("pos_size"), F.col("s.mtime").alias("pos_mtime"), F.col("s.offset").alias("pos_offset"))


def published_positions(spark: SparkSession, path: str, files_seen: DataFrame, scan_runs: DataFrame) -> VersionedTarget:
    """A target below path that holds, as its first version, the positions of the runs that ended
    well: source_key is the path, source_version what was loaded of it."""
    target = VersionedTarget(spark, path)
    rows = good_positions(files_seen, scan_runs).withColumnRenamed("path", "source_key")
    version = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("pos_size", "pos_mtime", "pos_offset")])
    target.publish(rows.withColumn("source_version", version), target.version())
    return target


def scan_states(files: DataFrame, file_listing: DataFrame, positions: DataFrame) -> DataFrame:
    """One row per listed file: (file_id, size, mtime, pos_size, pos_mtime, pos_offset)."""
    listed = present_files(file_listing).join(files.filter("path is not null").select("path", "file_id").distinct(), "path")
    held = positions.select(F.col("source_key").alias("path"), "pos_size", "pos_mtime", "pos_offset")
    return listed.join(held, "path", "left").drop("path")


def loaded_ranges(states: DataFrame, lines: DataFrame) -> DataFrame:
    """The target state that still holds: (file_id, loaded_to) of files with a position that were
    not rewritten since."""
    kept = states.filter(
        (F.col("size") >= F.col("pos_size"))
        & (F.col("mtime") >= F.col("pos_mtime") - 1)
        & ~((F.col("size") == F.col("pos_size")) & (F.col("mtime") > F.col("pos_mtime") + 1))
        & F.col("pos_offset").isNotNull()
    ).select("file_id", "size", F.col("pos_offset").alias("loaded_to"))
    at_end = kept.filter("loaded_to = size")
    starts = lines.select(F.col("file_id"), F.col("byte_start").alias("loaded_to"))
    at_line = kept.filter("loaded_to <> size").join(starts, ["file_id", "loaded_to"], "left_semi")
    return at_end.unionByName(at_line).select("file_id", "loaded_to")


def pending_lines(lines: DataFrame, files: DataFrame, file_listing: DataFrame, files_seen: DataFrame, scan_runs: DataFrame, path: str | None = None) -> DataFrame:
    """The finished lines that the next run must read, with all their columns. path: folder of the
    state's target (by default one of its own in the shared folder)."""
    spark = lines.sparkSession
    target = published_positions(spark, path or f"{shared_dir(spark)}/positions-{uuid.uuid4().hex}", files_seen, scan_runs)
    states, _ = materialize(scan_states(files, file_listing, target.read()), "states")
    last = F.greatest(F.floor((F.col("loaded_to") - 1) / CHUNK_BYTES), F.lit(0))
    loaded = loaded_ranges(states, lines).filter("loaded_to > 0").select(F.col("file_id").alias("__file"), "loaded_to", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__chunk"))
    source = lines.filter("has_newline")
    chunk = F.floor(F.coalesce(source["byte_start"], F.lit(0)) / CHUNK_BYTES)
    new = source.join(loaded, (source["file_id"] == loaded["__file"]) & (chunk == loaded["__chunk"]) & (source["byte_start"] < loaded["loaded_to"]), "left_anti")
    return new.join(states.select("file_id").distinct(), "file_id", "left_semi")


class VersionedTarget:
    """A table whose rows carry ``source_key`` and ``source_version``, published version by version.

    Layout below ``path``: ``data/<id>/rows`` holds the rows of one publish, ``data/<id>/keys`` the
    narrow summary of its source keys (and of those it retires), ``versions/<n>.json`` lists the
    folders of version n. A version exists once its file does: it is written aside and put under
    its name by a step that fails if the name is taken (see ``_put``), so of two runs that
    publish the same version one wins and the other must begin again. ``compact`` rewrites the live
    rows as one folder, ``vacuum`` deletes folders that no version lists (failed runs).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Number of the newest published version, 0 for none."""
        fs, p = hadoop_path(self.spark, f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def _manifest(self, version: int) -> list[dict]:
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _live(self, version: int | None, part: str) -> DataFrame | None:
        segments = self._manifest(self.version() if version is None else version)
        rows = None
        for n, s in enumerate(segments):
            own = self.spark.read.parquet(s[part]).withColumn("__segment", F.lit(n))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if len(segments) < 2:
            return None if rows is None else rows.drop("__segment")
        later = None
        for n, s in enumerate(segments[1:], 1):
            keys = self.spark.read.parquet(s["keys"]).select("source_key").withColumn("__later", F.lit(n))
            later = keys if later is None else later.unionByName(keys)
        latest = later.groupBy(F.col("source_key").alias("__key")).agg(F.max("__later").alias("__later"))
        hidden = rows.join(latest, (rows["source_key"] == latest["__key"]) & (rows["__segment"] < latest["__later"]), "left_anti")
        return hidden.drop("__segment")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default); None before the first publish. A row
        is hidden by a later publish that holds or retires its source key."""
        return self._live(version, "rows")

    def keys(self, version: int | None = None) -> DataFrame | None:
        """The narrow summary (source_key, source_version, ...) of the live source keys: the state a
        run begins from, without reading any row."""
        rows = self._live(version, "keys")
        return None if rows is None else rows.filter("not retired").drop("retired")

    def pending(self, source: DataFrame) -> DataFrame:
        """Source rows (with source_key, source_version) that the target does not hold yet in
        that version: new keys and changed ones, all their rows."""
        held = self.keys()
        if held is None:
            return source
        held = held.select("source_key", "source_version").distinct()
        same = (source["source_key"] == held["source_key"]) & source["source_version"].eqNullSafe(held["source_version"])
        return source.join(held, same, "left_anti")

    def publish(self, rows: DataFrame, base: int, retired: DataFrame | None = None, summary: DataFrame | None = None) -> int:
        """Add rows as the version after ``base``, the version the run began from. Source keys in
        ``rows`` or ``retired`` replace what earlier versions held of them. summary: a row per
        source key to be kept beside the rows (by default its keys and versions). Raises if another
        run published meanwhile; then nothing of this run is visible."""
        name = uuid.uuid4().hex
        segment = {"rows": f"{self.path}/data/{name}/rows", "keys": f"{self.path}/data/{name}/keys"}
        rows.write.parquet(segment["rows"])
        keys = summary if summary is not None else self.spark.read.parquet(segment["rows"]).select("source_key", "source_version").distinct()
        keys = keys.withColumn("retired", F.lit(False))
        if retired is not None:
            keys = keys.unionByName(retired.select("source_key", F.lit(True).alias("retired")).distinct(), allowMissingColumns=True)
        keys.write.parquet(segment["keys"])
        return self._commit(base, [*self._manifest(base), segment], name)

    def compact(self) -> int:
        """The newest version's live rows as one folder; publishes them as a version."""
        base, name = self.version(), uuid.uuid4().hex
        segment = {"rows": f"{self.path}/data/{name}/rows", "keys": f"{self.path}/data/{name}/keys"}
        self.read(base).write.parquet(segment["rows"])
        self.keys(base).withColumn("retired", F.lit(False)).write.parquet(segment["keys"])
        return self._commit(base, [segment], name)

    def vacuum(self) -> list[str]:
        """Delete the folders of rows that no version lists; only while no run is publishing."""
        fs, folder = hadoop_path(self.spark, f"{self.path}/data")
        listed = {s["rows"].rsplit("/", 2)[1] for v in range(1, self.version() + 1) for s in self._manifest(v)}
        gone = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName() not in listed]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]

    def _commit(self, base: int, segments: list[dict], name: str) -> int:
        if self.version() != base or not self._put(json.dumps(segments).encode(), f"{self.path}/data/{name}/manifest", f"{self.path}/versions/{base + 1}.json"):
            raise RuntimeError(f"version {base + 1} was published by another run; begin again from it")
        return base + 1

    def _put(self, content: bytes, aside: str, final: str) -> bool:
        """The content under its final name, whole or not at all, unless that name is taken. On a
        local or mounted file system a hard link does that; on a file system with atomic rename a
        rename that does not replace; on object stores, which show a file only once it is
        closed, a create that does not replace."""
        fs, target = hadoop_path(self.spark, final)
        fs.mkdirs(target.getParent())
        store = fs.getScheme() in OBJECT_STORES
        try:
            _, p = hadoop_path(self.spark, final if store else aside)
            out = fs.create(p, not store)
            out.write(bytearray(content))
            out.close()
            if store:
                return True
            if fs.getScheme() == "file":
                os.link(_local(aside), _local(final))
                return True
            jvm = self.spark._jvm
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), fs.getConf()).rename(p, target, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
