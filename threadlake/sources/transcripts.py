"""Transcripts as records: from JSON Lines files, or from a table of their physical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.sources.ranges import RANGE_BYTES, listing, read_ranges
from threadlake.storage import materialize

# Record kinds that make turns or titles, and known kinds of content blocks.
TURN_TYPES = ["user", "assistant"]
TITLE_TYPES = ["custom-title", "ai-title", "agent-name"]
KNOWN_RECORDS = [
    "user", "assistant", "system", "attachment", "ai-title", "custom-title", "agent-name", "mode", "permission-mode", "file-history-snapshot", "file-history-delta", "last-prompt",
    "queue-operation", "bridge-session", "atis-latch", "cost-state", "frame-link", "artifact-comment-monitor", "artifact-autoreact-ledger", "history-suppression",
]
KNOWN_BLOCKS = ["text", "thinking", "tool_use", "tool_result", "image", "document", "server_tool_use", "advisor_tool_result", "redacted_thinking"]
SKIPPED_MEMORY = r"^(MEMORY\.md|session_resume_.*\.md)$"


def roots(*folders: str) -> list[str]:
    """Folders without repetition, in order."""
    return list(dict.fromkeys(f.rstrip("/") for f in folders if f.strip()))


def _present(spark: SparkSession, patterns: list[str]) -> list[str]:
    from threadlake.storage import hadoop_path  # noqa: PLC0415

    out = []
    for pattern in patterns:
        fs, p = hadoop_path(spark, pattern)
        if fs.globStatus(p):
            out.append(pattern)
    return out


def read_lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, line_no, has_newline, raw, size, mtime) of the transcripts below the folders, both
    of sessions and of their subagents. The last line of a file without line break at its end has
    has_newline false and is not to be loaded yet."""
    return split_files(spark, _present(spark, [g for r in folders for g in (f"{r}/*/*.jsonl", f"{r}/*/*/subagents/*.jsonl")]))


def split_files(spark: SparkSession, globs: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The physical lines of the files, as ``read_lines`` gives them, read in byte ranges."""
    if not globs:
        return spark.createDataFrame([], "path string, line_no bigint, has_newline boolean, raw string, size bigint, mtime double")
    files, _ = materialize(listing(spark, globs), "files")
    lines = read_ranges(files.select("path", "size", F.lit(0).cast("bigint").alias("from_offset"), F.lit(0).cast("bigint").alias("from_line")), range_bytes)
    return lines.join(files, "path").select("path", "line_no", "has_newline", "raw", "size", "mtime")


def read_notes(spark: SparkSession, folders: list[str], pattern: str = "*/memory/*.md", skip: str = SKIPPED_MEMORY) -> DataFrame:
    """(path, stem, text, size, mtime) of markdown files whose names aren't skipped."""
    globs = _present(spark, [f"{r}/{pattern}" for r in folders])
    if not globs:
        return spark.createDataFrame([], "path string, stem string, text string, size bigint, mtime double")
    name = F.element_at(F.split("path", "/"), -1)
    rows = spark.read.text(globs, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), (F.unix_micros(F.col("_metadata.file_modification_time")) / 1e6).alias("mtime"))
    return rows.filter(~name.rlike(skip)).select("path", F.regexp_replace(name, r"\.md$", "").alias("stem"), "text", "size", "mtime")


def _last_key_counts(spark: SparkSession) -> None:
    """The one session setting the reader needs, as the parser takes it from nowhere else; a
    session that sets it otherwise is told so rather than changed."""
    name = "spark.sql.variant.allowDuplicateKeys"
    held = spark.conf.get(name)
    if held != "true":
        if name in {k for k, _ in spark.sparkContext.getConf().getAll()}:
            raise ValueError(f"records need {name}=true")
        spark.conf.set(name, "true")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def records(lines: DataFrame, keep: list[str], holding: str | None = None) -> DataFrame:
    """The lines that are JSON objects, typed, with the columns ``keep`` of the lines. Lines that
    are not finished, not valid or no objects are left out (problem 5 gives them with reasons).
    Column content is the message content as a variant; of repeated keys the last counts. With
    holding only lines in which that text stands are parsed at all (a plain search before the
    parse): for callers that need a key, as a record can't have it otherwise."""
    _last_key_counts(lines.sparkSession)
    if holding is not None:
        lines = lines.filter(F.contains("raw", F.lit(holding)))
    # read inside brackets, so that anything after the object makes the line invalid; exploded, so
    # that the parse is a step of its own, which no filter is moved below of or computes again
    v = F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    opens = F.ltrim(F.col("raw"), F.lit(" \t\n\r")).startswith("{")
    rows = lines.filter(F.col("has_newline") & opens).select(*keep, F.explode(F.array(v)).alias("v")).filter("v is not null and try_variant_get(v, '$[1]', 'variant') is null")
    v = F.col("v")
    flag = lambda name: F.coalesce(_get(v, f"$[0].{name}", "boolean"), F.lit(False))
    return rows.select(
        *keep,
        _get(v, "$[0].type").alias("type"),
        F.coalesce(F.nullif(_get(v, "$[0].sessionId"), F.lit("")), F.nullif(_get(v, "$[0].session_id"), F.lit(""))).alias("own_session"),
        _get(v, "$[0].timestamp").alias("ts"),
        F.nullif(_get(v, "$[0].cwd"), F.lit("")).alias("cwd"),
        F.nullif(_get(v, "$[0].gitBranch"), F.lit("")).alias("git_branch"),
        F.nullif(_get(v, "$[0].entrypoint"), F.lit("")).alias("entrypoint"),
        flag("isSidechain").alias("is_sidechain"),
        (flag("isMeta") | flag("isCompactSummary") | flag("isVisibleInTranscriptOnly")).alias("is_meta"),
        F.nullif(_get(v, "$[0].customTitle"), F.lit("")).alias("custom_title"),
        F.nullif(F.when(_get(v, "$[0].type") == TITLE_TYPES[1], _get(v, "$[0].aiTitle")).when(_get(v, "$[0].type") == TITLE_TYPES[2], _get(v, "$[0].agentName")), F.lit("")).alias("auto_title"),
        _get(v, "$[0].subtype").alias("subtype"),
        F.nullif(_get(v, "$[0].uuid"), F.lit("")).alias("uuid"),
        F.nullif(_get(v, "$[0].parentUuid"), F.lit("")).alias("parent_uuid"),
        _get(v, "$[0].message.role").alias("role"),
        _get(v, "$[0].message.content", "variant").alias("content"),
        _get(v, "$[0].message.usage", "variant").alias("usage"),
    )


def blocks(content: Column) -> Column:
    """The content's blocks; null unless it is a list."""
    return F.try_variant_get(content, "$", "array<variant>")


def blocks_text(content: Column) -> Column:
    """A plain text as it is, of a list the text blocks joined by line breaks, else empty."""
    texts = F.filter(blocks(content), lambda b: _get(b, "$.type") == "text")
    joined = F.array_join(F.transform(texts, lambda b: F.coalesce(_get(b, "$.text"), F.lit(""))), "\n")
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return F.coalesce(joined, plain, F.lit(""))
