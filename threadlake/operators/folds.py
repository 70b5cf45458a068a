"""Folds of records and turns into catalogues, counters, statistics and audits.

Order-dependent folds carry their order (line numbers) into min_by/max_by, never first/last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.instants import non_blank
from threadlake.functions.text import NOTE_REDACTIONS, WS, clean_text, leaks, project_for, redact, shorten, strip_note_tags, strip_text
from threadlake.sources.transcripts import KNOWN_BLOCKS, KNOWN_RECORDS, TITLE_TYPES, TURN_TYPES, blocks, blocks_text
from threadlake.storage import materialize

#: The tools that change a file, and those that run commands.
EDITORS = ["Write", "Edit", "MultiEdit", "NotebookEdit"]
SHELLS = ["Bash"]
INTERRUPTED = "[Request interrupted"


def inherited(keys: DataFrame, file: str, line: str) -> DataFrame:
    """(file, line, session_id) of the rows of keys (file, line, own_session) without a session of
    their own: the last above in the file, or null. Rows are sorted by range partitions, and what
    a partition begins with is carried over from those before, so no file needs to fit in a task."""
    ranged, _ = materialize(keys.select(F.col(file).alias("f"), F.col(line).alias("l"), "own_session").repartitionByRange("f", "l").withColumn("pid", F.spark_partition_id()), "lines")
    local = ranged.withColumn("above", F.last("own_session", ignorenulls=True).over(Window.partitionBy("f", "pid").orderBy("l")))
    ends = ranged.groupBy("f", "pid").agg(F.max_by("own_session", F.when(F.col("own_session").isNotNull(), F.col("l"))).alias("own"))
    before = Window.partitionBy("f").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("f").alias("ef"), F.col("pid").alias("epid"), F.last("own", ignorenulls=True).over(before).alias("carried"))
    lacking = local.filter("own_session is null").join(ends, F.col("f").eqNullSafe(F.col("ef")) & (F.col("pid") == F.col("epid")))
    return lacking.groupBy("f", "l").agg(F.max(F.coalesce("above", "carried")).alias("__session"))


def inherit_sessions(records: DataFrame, file: str = "file_id", line: str = "line_no") -> DataFrame:
    """Records but meta ones, with ``session_id``: their own or the last above in the file; those
    without one are dropped. Only line numbers and ids are sorted, and only records without an
    id of their own are joined; all others pass as they are read."""
    rows = records.filter(~F.col("is_meta"))
    found, _ = materialize(inherited(rows.select(file, line, "own_session"), file, line).filter("__session is not null"), "inherited")
    own = rows.filter("own_session is not null").withColumn("session_id", F.col("own_session"))
    lacking = rows.filter("own_session is null").join(found, F.col(file).eqNullSafe(F.col("f")) & (F.col(line) == F.col("l")))
    return own.unionByName(lacking.withColumn("session_id", F.col("__session")).drop("f", "l", "__session"))


def said(content: Column) -> Column:
    """The text of a record's content, without injected blocks and credentials."""
    return clean_text(blocks_text(content))


def turns_of(records: DataFrame) -> DataFrame:
    """The turns that records make: user and assistant records whose cleaned text has at least
    two characters; what a program fed in is no text."""
    rows = records.filter(F.col("type").isin(TURN_TYPES))
    headless = (F.col("type") == "user") & (F.coalesce("entrypoint", F.lit("")) == "sdk-cli")
    return rows.withColumn("text", F.when(headless, "").otherwise(said(F.col("content")))).filter(F.length("text") >= 2)


def _last(column: str, line: str, when: Column | None = None) -> Column:
    ok = F.col(column).isNotNull() if when is None else F.col(column).isNotNull() & when
    return F.max_by(column, F.when(ok, F.col(line)))


def _first(column: str, line: str, when: Column) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull() & when, F.col(line)))


def session_files(records: DataFrame, file: str = "file_id", line: str = "line_no") -> DataFrame:
    """``fold_files`` of records whose sessions are yet to be inherited."""
    return fold_files(inherit_sessions(records, file, line), file, line)


def fold_files(rows: DataFrame, file: str = "file_id", line: str = "line_no") -> DataFrame:
    """One row per (session, file) with a turn or title record: of the turn records the last folder,
    branch and entry point and the first and last time; the title (last one given by hand, else
    the first automatic one), masked, with title_custom telling whether it was given by hand; and
    the first user message, cleaned."""
    rows = rows.filter(F.col("type").isin(*TURN_TYPES, *TITLE_TYPES))
    turn = F.col("type").isin(TURN_TYPES)
    typed = (F.col("type") == "user") & ~F.col("is_sidechain") & (F.coalesce("entrypoint", F.lit("")) != "sdk-cli")
    rows = rows.withColumn("text", F.when(typed, said(F.col("content"))))
    first = (F.length("text") >= 2) & ~F.col("text").startswith("<")
    rows = rows.withColumn("text", F.when(first, F.substring("text", 1, 400)))
    stamp = F.when(turn, F.nullif("ts", F.lit("")))
    custom = _last("custom_title", line, F.col("type") == TITLE_TYPES[0])
    return rows.groupBy("session_id", file).agg(
        _last("cwd", line, turn).alias("cwd"),
        _last("git_branch", line, turn).alias("git_branch"),
        _last("entrypoint", line, turn).alias("entrypoint"),
        F.min(stamp).alias("started_at"),
        F.max(stamp).alias("ended_at"),
        redact(F.coalesce(custom, _first("auto_title", line, F.col("type").isin(TITLE_TYPES[1:])))).alias("title"),
        custom.isNotNull().alias("title_custom"),
        _first("text", line, F.col("text").isNotNull()).alias("first_user_msg"),
    )


def merge_state(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Earlier rows merged with those of a later pass: a new folder, branch or entry point beats the
    old one; a title given by hand in the later pass beats the old title, and that an automatic
    one; the old first message stays; times widen."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, keys, "full_outer")
    newer = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    older = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    custom = lambda t: F.coalesce(F.col(f"{t}.title_custom"), F.lit(False))
    return both.select(
        *keys, newer("cwd"), newer("git_branch"), newer("entrypoint"),
        F.least(F.col("a.started_at"), F.col("b.started_at")).alias("started_at"),
        F.greatest(F.col("a.ended_at"), F.col("b.ended_at")).alias("ended_at"),
        F.when(custom("b"), F.col("b.title")).otherwise(F.coalesce("a.title", "b.title")).alias("title"),
        (custom("a") | custom("b")).alias("title_custom"), older("first_user_msg"),
    )


def sessions_rollup(files: DataFrame, turns: DataFrame, file: str = "file_id") -> DataFrame:
    """One row per session over its files, with counts of its turns (sidechain ones included)
    and the characters of their texts."""
    latest = F.struct(F.col("ended_at"), F.col(file))
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), latest)).alias(c)
    own = files.groupBy("session_id").agg(
        pick("cwd"), pick("git_branch"), pick("title"), pick("entrypoint"),
        F.min_by("first_user_msg", F.when(F.col("first_user_msg").isNotNull(), F.struct(F.coalesce("started_at", F.lit("~")), F.col(file)))).alias("first_user_msg"),
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
    )
    said = turns.groupBy("session_id").agg(F.count_if(F.col("type") == "user").alias("n_user"), F.count_if(F.col("type") == "assistant").alias("n_assistant"), F.sum(F.length("text")).alias("chars_text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return own.join(said, "session_id", "left").select(*own.columns, zero("n_user"), zero("n_assistant"), zero("chars_text"))


def touches(records: DataFrame, keep: list[str], path_chars: int = 400, command_chars: int = 200) -> DataFrame:
    """Tools, files and commands that assistant records use: (keep..., pos, kind, value). Values
    are masked before they are cut, so a cut never hides a credential from the mask."""
    rows = records.filter(F.col("type") == "assistant").select(*keep, F.posexplode(blocks(F.col("content"))).alias("pos", "b"))
    rows = rows.filter(F.try_variant_get("b", "$.type", "string") == "tool_use")
    got = lambda p: F.try_variant_get("b", p, "string")
    used = F.array(
        F.struct(F.lit("tool").alias("kind"), F.coalesce(F.nullif(got("$.name"), F.lit("")), F.lit("?")).alias("value")),
        *[F.struct(F.lit("file").alias("kind"), F.substring(redact(got(f"$.input.{k}")), 1, path_chars).alias("value")) for k in ("file_path", "path", "notebook_path")],
        F.struct(F.lit("command").alias("kind"), F.substring(redact(got("$.input.command")), 1, command_chars).alias("value")),
    )
    return rows.select(*keep, "pos", F.inline(used)).filter("value is not null and value <> ''")


def delta_uses(records: DataFrame, keep: list[str], editors: list[str] = EDITORS, shells: list[str] = SHELLS, command_chars: int = 300) -> DataFrame:
    """Files written or edited, shell commands and texts of assistant records: (keep..., pos, kind,
    tool, value), kind being edit, command or text. A path is whole; a command is put on one line,
    masked and then shortened; a text is as it is."""
    rows = records.filter(F.col("type") == "assistant").select(*keep, F.posexplode(blocks(F.col("content"))).alias("pos", "b"))
    got = lambda p: F.nullif(F.try_variant_get("b", p, "string"), F.lit(""))
    path = F.coalesce(got("$.input.file_path"), got("$.input.notebook_path"))
    line = strip_text(F.regexp_replace(got("$.input.command"), f"(?U)[{WS}]+", " "))
    rows = rows.select(*keep, "pos", F.try_variant_get("b", "$.type", "string").alias("block"), got("$.name").alias("tool"), path.alias("path"), line.alias("line"), got("$.text").alias("text"))
    used = F.col("block") == "tool_use"
    kind = F.when(used & F.col("tool").isin(editors) & F.col("path").isNotNull(), "edit").when(used & F.col("tool").isin(shells) & F.col("line").isNotNull(), "command").when((F.col("block") == "text") & non_blank(F.col("text")), "text")
    masked = lambda c: redact(F.col(c), NOTE_REDACTIONS)
    value = F.when(kind == "edit", masked("path")).when(kind == "command", shorten(masked("line"), command_chars)).otherwise(F.col("text"))
    return rows.select(*keep, "pos", kind.alias("kind"), "tool", value.alias("value")).filter("kind is not null")


def delta_messages(records: DataFrame, keep: list[str], most_chars: int = 1500) -> DataFrame:
    """What users typed: (keep..., text), without tags, requests that were interrupted left out,
    masked and then shortened."""
    rows = records.filter(F.col("type") == "user").select(*keep, strip_note_tags(blocks_text(F.col("content"))).alias("text"))
    rows = rows.filter((F.col("text") != "") & ~F.col("text").startswith(INTERRUPTED))
    return rows.withColumn("text", shorten(redact(F.col("text"), NOTE_REDACTIONS), most_chars))


def touch_counts(used: DataFrame, keys: list[str], line: str = "line_no", ts: str = "ts") -> DataFrame:
    """Touches counted by keys, kind and value, with the times of the first and the last in
    scan order."""
    order = F.struct(F.col(line), F.col("pos"))
    stamped = F.when(F.col(ts).isNotNull(), order)
    return used.groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"), F.min_by(ts, stamped).alias("first_ts"), F.max_by(ts, stamped).alias("last_ts"))


def record_types(records: DataFrame) -> DataFrame:
    """(kind, n, known) of the records."""
    return records.groupBy(F.coalesce("type", F.lit("?")).alias("kind")).agg(F.count("*").alias("n")).withColumn("known", F.col("kind").isin(KNOWN_RECORDS))


def block_types(records: DataFrame) -> DataFrame:
    """(kind, n, known) of the content blocks."""
    kinds = records.filter("content is not null").select(F.explode(blocks(F.col("content"))).alias("b")).filter("b is not null and schema_of_variant(b) like 'OBJECT%'")
    return kinds.groupBy(F.coalesce(F.try_variant_get("b", "$.type", "string"), F.lit("?")).alias("kind")).agg(F.count("*").alias("n")).withColumn("known", F.col("kind").isin(KNOWN_BLOCKS))


def last_usage(records: DataFrame, file: str = "file_id", line: str = "line_no") -> DataFrame:
    """(file, line, tokens) of each file's newest main-thread answer with usage. Of answers with
    iterations the last one of kind message counts, not the sum over them."""
    count = lambda v, k: F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0))
    total = lambda v: count(v, "input_tokens") + count(v, "cache_read_input_tokens") + count(v, "cache_creation_input_tokens")
    rounds = F.filter(F.coalesce(F.try_variant_get("usage", "$.iterations", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda b: F.try_variant_get(b, "$.type", "string") == "message")
    rows = records.filter((F.col("type") == "assistant") & ~F.col("is_sidechain")).filter("usage is not null and schema_of_variant(usage) like 'OBJECT%'")
    rows = rows.withColumn("last_round", F.when(F.size(rounds) > 0, F.element_at(rounds, -1)))
    tokens = F.when(F.col("last_round").isNotNull(), total("last_round")).otherwise(total("usage"))
    return rows.select(file, line, tokens.alias("tokens")).groupBy(file).agg(F.max(line).alias(line), F.max_by("tokens", line).alias("tokens"))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The newest row of each session."""
    row = F.struct(*[c for c in sessions.columns if c != "session_id"])
    return sessions.groupBy("session_id").agg(F.max_by(row, F.struct("indexed_at", "jsonl_path")).alias("r")).select("session_id", "r.*")


def totals(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of archive statistics."""
    t = turns.agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if("is_sidechain").alias("sidechain"))
    s = sessions.agg(F.count("*").alias("sessions"), F.count_distinct("project").alias("projects"), F.min("started_at").alias("first"), F.max("ended_at").alias("last"))
    return t.join(F.broadcast(s))


def busiest_projects(sessions: DataFrame, limit: int = 10) -> DataFrame:
    per = sessions.groupBy("project").agg(F.count("*").alias("n"), F.max("ended_at").alias("last"))
    return per.orderBy(F.desc("n"), F.asc_nulls_first("project")).limit(limit)


def duplicates(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several turns share."""
    return turns.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def count_mismatches(sessions: DataFrame, turns: DataFrame, role: str = "role") -> DataFrame:
    """Sessions whose stored number of user turns is not the number there is."""
    real = turns.groupBy("session_id").agg(F.count_if(F.col(role) == "user").alias("counted"))
    both = sessions.select("session_id", F.col("n_user").alias("stored")).join(real, "session_id", "left")
    return both.select("session_id", "stored", F.coalesce("counted", F.lit(0)).alias("counted")).filter(~F.col("stored").eqNullSafe(F.col("counted")))


def reextracted(turns: DataFrame, records: DataFrame, least_chars: int = 40) -> DataFrame:
    """(turn_id, state) of stored turns: same, different or missing, as their text is what cleaning
    the record at their file and line gives, something else, or there is no such record."""
    stored = turns.filter(F.length("text") > least_chars).select("turn_id", "file_id", "line_no", F.xxhash64("text").alias("stored"), F.length("text").alias("n"))
    again = records.select("file_id", "line_no", said(F.col("content")).alias("text")).select("file_id", "line_no", F.xxhash64("text").alias("again"), F.length("text").alias("m"))
    both = stored.join(again, ["file_id", "line_no"], "left")
    state = F.when(F.col("again").isNull(), "missing").when((F.col("again") == F.col("stored")) & (F.col("n") == F.col("m")), "same").otherwise("different")
    return both.select("turn_id", state.alias("state"))


def orphans(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns of sessions that the catalogue lacks."""
    return turns.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def leak_audit(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, n): texts that expose a credential. Each source is a table with a column text."""
    out = None
    for name, rows in sources.items():
        part = rows.select(F.lit(name).alias("source"), leaks(F.col("text")).alias("leak"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("source").agg(F.count_if("leak").alias("n"))


def with_project(files: DataFrame, path: str = "path", workspace: str | None = None, home: str | None = None) -> DataFrame:
    return files.withColumn("project", project_for(F.col("cwd"), F.col(path), workspace, home))
