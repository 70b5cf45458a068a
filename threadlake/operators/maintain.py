"""Upkeep: scan plans, snapshot differences, forgetting, note parsing, names from folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import strip_text
from threadlake.storage import broadcast_if_bounded


def scan_plan(manifest: DataFrame, present: DataFrame, full: bool = False) -> DataFrame:
    """(path, action, from_offset) per present file: restart, append or skip. manifest has path,
    size, mtime, offset; present has path, size, mtime."""
    m = manifest.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("offset").alias("__offset"))
    rows = present.join(m, "path", "left")
    restart = F.lit(full) | F.col("__offset").isNull() | (F.col("size") < F.col("__size")) | (F.col("__mtime") > F.col("mtime") + 1.0)
    action = F.when(restart, "restart").when(F.col("__offset") >= F.col("size"), "skip").otherwise("append")
    return rows.select("path", action.alias("action"), F.when(action == "append", F.col("__offset")).otherwise(0).alias("from_offset"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """(key, action) with action add, change, same or delete; version columns tell changes."""
    o = old.select(F.col(key).alias("__k"), F.struct(*version).alias("__o"))
    n = new.select(F.col(key).alias("__j"), F.struct(*version).alias("__n"))
    both = o.join(n, F.col("__k") == F.col("__j"), "full_outer")
    action = F.when(F.col("__k").isNull(), "add").when(F.col("__j").isNull(), "delete").when(F.col("__o").eqNullSafe(F.col("__n")), "same").otherwise("change")
    return both.select(F.coalesce("__k", "__j").alias(key), action.alias("action"))


def forget(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows without those of the given sessions."""
    return rows.join(broadcast_if_bounded(sessions.select("session_id").distinct()), "session_id", "left_anti")


def forget_counts(tables: dict[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """(table, n): what forgetting the sessions would delete."""
    gone, out = broadcast_if_bounded(sessions.select("session_id").distinct()), None
    for name, rows in tables.items():
        part = rows.join(gone, "session_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def tombstones(session_files: DataFrame, sessions: DataFrame) -> DataFrame:
    """(path): every file that holds one of the forgotten sessions. A tombstone is per file, so other
    sessions of the same file are not read again either. session_files: session_id, path."""
    return forget_semi(session_files, sessions).filter("path is not null").select("path").distinct()


def forget_semi(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows of the given sessions."""
    return rows.join(broadcast_if_bounded(sessions.select("session_id").distinct()), "session_id", "left_semi")


def drop_tombstoned(present: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to scan, tombstones to keep): forgotten files are not scanned again; a tombstone
    goes once its file has."""
    return present.join(tombstones.select("path"), "path", "left_anti"), tombstones.join(present.select("path"), "path", "left_semi")


def rebuild(archived: DataFrame, fresh: DataFrame, present: DataFrame) -> DataFrame:
    """Fresh rows, and archived rows of files that are gone."""
    return fresh.unionByName(archived.join(present.select("path"), "path", "left_anti"), allowMissingColumns=True)


def drop_files(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("path"), "path", "left_anti")


def longest_prefix(names: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, project): the known slug that equals the name or is its longest beginning before a
    hyphen. Every beginning is looked up by an equi-join, not compared with every known one."""
    parts = F.split("slug", "-")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    tried = names.select("slug").distinct().select("slug", F.explode(starts).alias("known_slug"))
    return tried.join(known, "known_slug").groupBy("slug").agg(F.max_by("project", F.length("known_slug")).alias("project"))


def nearest_ancestor(folders: DataFrame, catalogue: DataFrame, most: int = 6) -> DataFrame:
    """(cwd, hit): the nearest folder at or above cwd that the catalogue lists (column folder; with a
    column root, (cwd, hit, root) of the nearest, of several roots the one that sorts first)."""
    parts = F.split("cwd", "/")
    up = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size(parts) - 2)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - n), "/").alias("folder")))
    tried = folders.select("cwd").distinct().filter(F.size(parts) >= 2).select("cwd", F.inline(up))
    if "root" not in catalogue.columns:
        return tried.join(catalogue.select("folder").distinct(), "folder").groupBy("cwd").agg(F.min_by("folder", "depth").alias("hit"))
    best = F.min(F.struct("depth", "root", "folder")).alias("b")
    return tried.join(catalogue.select("folder", "root").distinct(), "folder").groupBy("cwd").agg(best).select("cwd", F.col("b.folder").alias("hit"), "b.root")


def origin_of(text: Column, head: int = 2000) -> Column:
    """The session that a note says it comes from, null if it says none in its head."""
    return F.nullif(F.regexp_extract(F.substring(text, 1, head), r"(?m)^\s*originSessionId:\s*([0-9a-f-]{8,})", 1), F.lit(""))


def parse_note(text: Column, stem: Column) -> Column:
    """struct(name, description, mtype, body) of a markdown note with optional front matter: the
    last top-level name that isn't empty, the last top-level description, the first type."""
    found = text.startswith("---") & (F.locate("\n---", text, 4) > 0)
    end = F.locate("\n---", text, 4)
    front = F.when(found, F.substring(text, F.lit(4), end - 4))
    body = F.when(found, F.substring(text, end + 4, F.length(text))).otherwise(text)
    value = lambda line: _unquote(strip_text(F.regexp_extract(line, r"(?s)^\s*(?:name|description|type):\s*(.*)$", 1)))
    lines = F.split(front, "\r\n|\n|\r")
    names = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^name:")), value), lambda v: v != "")
    descriptions = F.transform(F.filter(lines, lambda x: x.rlike(r"^description:")), value)
    kinds = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*type:")), value), lambda v: v != "")
    return F.struct(
        F.coalesce(F.try_element_at(names, F.lit(-1)), stem).alias("name"),
        F.coalesce(F.try_element_at(descriptions, F.lit(-1)), F.lit("")).alias("description"),
        F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("")).alias("mtype"),
        strip_text(body).alias("body"),
    )


def _unquote(v: Column) -> Column:
    first = F.substring(v, 1, 1)
    quoted = (F.length(v) >= 2) & first.isin("'", '"') & (first == F.substring(v, -1, 1))
    return F.when(quoted, F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('\\"'), F.lit('"'))).otherwise(v)


def lint(lines: DataFrame, pattern: str, allowed: str) -> DataFrame:
    """The first match of each line after what is allowed has been taken out."""
    hit = F.regexp_extract(F.regexp_replace("text", allowed, ""), f"({pattern})", 1)
    return lines.withColumn("hit", hit).filter("hit <> ''")


def choose_note(notes: DataFrame, session: str = "session_id") -> DataFrame:
    """The note to load per session: one it wrote itself before one that names it as origin,
    before the newest; none if all are foreign. notes: session, path, mtime, own, origin."""
    priority = F.when(F.col("own"), 0).when(F.col("origin") == F.col(session), 1).when(F.col("origin").isNull(), 2)
    w = Window.partitionBy(session).orderBy("priority", F.desc("mtime"), "path")
    return notes.withColumn("priority", priority).filter("priority is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
