"""Problem 3: conversations rebuilt from message rows.

A message's parent is the one before it: in its file the one with the preceding seq, at the
beginning of a file the last of the session's preceding file. Messages are first contracted to
segments of at most ``SEGMENT`` consecutive seq of one file, each one row that holds its messages'
ids in order; the segments' parent pointers are then resolved by pointer-jumping joins
(``pointers.resolve``), which carry a path summary: messages so far, first and last speaker, broken
or not. A segment whose parent is missing is an orphan and breaks its conversation. The last
segment's summary decides whether the conversation is kept, and every segment's tells at which
position it begins, so root-to-leaf paths are emitted by one join without gathering a conversation
in a task. Messages are shuffled once, copies having been dropped batch by batch before.

``threads`` resolves pointers that records carry themselves (uuid and parentUuid), message by
message, and tells rooted threads, orphans and cycles apart.

Defined cases. Null session ids belong to no conversation. A null file is a file of its own; a
null seq, a seq below 1 or a gap breaks the conversation, so do a null, blank or unreadable role or
text in a message that isn't sidechain. A null is_sidechain means false. Of rows equal in
(session_id, file_id, seq) the lowest turn_id counts, whatever the others say. Files without a
readable time come last, ties go by file_id. Empty tables give no conversations. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.instants import instant_key, non_blank
from threadlake.llm.pointers import resolve
from threadlake.storage import materialize

#: Longest stretch of seq that is one node of the pointer jumping.
SEGMENT = 32

#: How roles are spelled, and their codes (0 is unknown).
ROLES = {"user": 1, "human": 1, "assistant": 2, "ai": 2, "model": 2, "system": 3}
ROLE_NAMES = {1: "user", 2: "assistant", 3: "system"}
USER, ASSISTANT, SYSTEM = 1, 2, 3


def role_code(role: Column) -> Column:
    """1 user, 2 assistant, 3 system, 0 unknown; ignoring case and outer blanks."""
    name = F.lower(F.regexp_replace(role, r"^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$", ""))
    out = F.lit(0)
    for spelled, code in ROLES.items():
        out = F.when(name == spelled, code).otherwise(out)
    return out


_ROW = "session_id string, file_id bigint, segment bigint, seq bigint, turn_id bigint, flags int, sec bigint, frac bigint, rest string"
_KEY = ["session_id", "file_id", "segment", "seq"]


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a batch that are copies of a message the one with the lowest turn_id: however
    many copies there are, few of each are shuffled."""
    for b in batches:
        table = pa.Table.from_batches([b])
        keys = table.group_by(_KEY, use_threads=False).aggregate([("turn_id", "min")])
        if len(keys) < len(table):
            table = table.sort_by([("turn_id", "ascending")])
            firsts = table.append_column("at", pa.array(range(len(table)), pa.int64())).group_by(_KEY, use_threads=False).aggregate([("at", "min")])
            table = table.take(firsts.column("at_min"))
        yield from table.combine_chunks().to_batches()


def _messages(turns: DataFrame) -> DataFrame:
    """One narrow row per message, those of a segment in one partition."""
    when = instant_key(F.col("ts"))
    seq = F.col("seq").cast("bigint")
    rows = turns.filter("session_id is not null").select(
        "session_id",
        F.col("file_id").cast("bigint").alias("file_id"),
        F.coalesce(F.floor((seq - 1) / SEGMENT), F.lit(-1)).cast("bigint").alias("segment"),
        seq.alias("seq"),
        F.col("turn_id").cast("bigint").alias("turn_id"),
        (role_code(F.col("role")) + F.when(F.coalesce(F.col("is_sidechain"), F.lit(False)), 0).otherwise(4) + F.when(non_blank(F.col("text")), 8).otherwise(0)).cast("int").alias("flags"),
        when["sec"].alias("sec"),
        when["frac"].alias("frac"),
        when["rest"].alias("rest"),
    )
    rows = rows.mapInArrow(_first_copies, _ROW).repartition("session_id", "file_id", "segment")
    return rows.groupBy(*_KEY).agg(F.min("turn_id").alias("turn_id"), *[F.min_by(c, "turn_id").alias(c) for c in ("flags", "sec", "frac", "rest")])


def _segments(messages: DataFrame) -> DataFrame:
    """Summaries of the segments, with their messages' ids; contiguous ones begin where they must."""
    held = F.array_sort(F.collect_list(F.struct("seq", "turn_id", F.coalesce("flags", F.lit(4)).alias("flags"))))
    rows = messages.groupBy("session_id", "file_id", "segment").agg(held.alias("m"), F.min(F.when(F.col("sec").isNotNull(), F.struct("sec", "frac", "rest"))).alias("first_ts"))
    role = lambda r: r["flags"].bitwiseAND(3)
    rows = rows.withColumn("main", F.filter("m", lambda r: r["flags"].bitwiseAND(4) > 0)).withColumn("lo", F.get("m", F.lit(0))["seq"]).withColumn("hi", F.element_at("m", -1)["seq"])
    rows = rows.withColumn("talk", F.filter(F.transform("main", role), lambda r: r.isin(USER, ASSISTANT)))
    bad = F.exists("main", lambda r: (role(r) == 0) | (r["flags"].bitwiseAND(8) == 0))
    gap = F.coalesce(F.size("m") != F.col("hi") - F.col("lo") + 1, F.lit(True)) | F.coalesce(F.col("lo") != F.col("segment") * SEGMENT + 1, F.lit(True))
    return rows.select(
        "session_id", "file_id", "segment", "hi", "first_ts",
        F.size("main").cast("bigint").alias("own"),
        F.get("talk", F.lit(0)).alias("first"),
        F.try_element_at("talk", F.lit(-1)).alias("last"),
        (bad | (F.col("segment") < 0) | gap | F.array_join(F.transform("talk", lambda r: r.cast("string")), "").contains(f"{USER}{USER}")).alias("broken"),
        F.transform("main", lambda r: r["turn_id"]).alias("turn_ids"),
        F.coalesce(F.col("file_id").cast("string"), F.lit("")).alias("file"),
    )


def _file_links(segments: DataFrame) -> DataFrame:
    """Each file with its session's preceding file. Files are ordered in two levels, within the
    hour they begin in and over those hours, so a session of very many files is no single group."""
    files = segments.groupBy("session_id", "file", "file_id").agg(F.min("first_ts").alias("ts"), F.max("segment").alias("last_segment"))
    files = files.withColumn("hour", F.coalesce(F.floor(F.col("ts.sec") / 3600), F.lit((1 << 62))).cast("bigint"))
    order = [F.col("ts").asc_nulls_last(), F.col("file_id").asc_nulls_first()]
    inner = Window.partitionBy("session_id", "hour").orderBy(*order)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tail = F.struct(F.col("file").alias("file"), F.col("last_segment").alias("segment"))
    files = files.withColumn("prev", F.lag(tail).over(inner)).withColumn("tail", F.last(tail).over(whole))
    hours = files.filter("prev is null").select("session_id", "hour", "tail")
    hours = hours.select("session_id", "hour", F.lag("tail").over(Window.partitionBy("session_id").orderBy("hour")).alias("hour_prev"), F.lead("hour").over(Window.partitionBy("session_id").orderBy("hour")).isNull().alias("last_hour"))
    linked = files.join(hours, ["session_id", "hour"])
    is_last = F.col("last_hour") & (F.col("tail.file") == F.col("file"))
    return linked.select("session_id", "file", "last_segment", F.coalesce("prev", "hour_prev").alias("prev"), is_last.alias("last_file"))


def _combine(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    follows = F.coalesce((a["last"] == USER) & (b["first"] == USER), F.lit(False))
    return {
        "upto": a["upto"] + b["upto"],
        "hops": a["hops"] + b["hops"],
        "broken": a["broken"] | b["broken"] | follows,
        "first": F.coalesce(a["first"], b["first"]),
        "last": F.coalesce(b["last"], a["last"]),
    }


def rebuild(turns: DataFrame) -> DataFrame:
    """(session_id, pos, turn_id) of every message of the kept conversations."""
    whole, _ = materialize(_segments(_messages(turns)).withColumn("node", F.monotonically_increasing_id()), "segments")
    segments = whole.drop("turn_ids")
    links = _file_links(segments)
    linked = segments.join(links, ["session_id", "file"])
    in_file = F.col("segment") > 0
    linked = linked.select(
        "session_id", "file", "file_id", "segment", "node", "own", "first", "last",
        (F.col("broken") | ((F.col("segment") < F.col("last_segment")) & (F.col("hi") != (F.col("segment") + 1) * SEGMENT))).alias("broken"),
        F.when(in_file, F.col("file")).otherwise(F.col("prev.file")).alias("up_file"),
        F.when(in_file, F.col("segment") - 1).otherwise(F.col("prev.segment")).alias("up_segment"),
        (F.col("last_file") & (F.col("segment") == F.col("last_segment"))).alias("leaf"),
    )
    up = segments.select(F.col("session_id").alias("s"), F.col("file").alias("f"), F.col("segment").alias("g"), F.col("node").alias("up"))
    linked = linked.join(up, (linked["session_id"] == up["s"]) & (linked["up_file"] == up["f"]) & (linked["up_segment"] == up["g"]), "left").drop("s", "f", "g")
    # a parent that should be there and is not keeps an id that no node has
    linked = linked.withColumn("parent", F.coalesce("up", F.when(F.col("up_segment").isNotNull(), F.lit(-1).cast("bigint")))).drop("up", "up_file", "up_segment")
    linked, _ = materialize(linked, "links")
    nodes = linked.select("node", "parent", F.col("own").alias("upto"), F.lit(1).cast("bigint").alias("hops"), "broken", "first", "last")
    paths = resolve(nodes, ["upto", "hops", "broken", "first", "last"], _combine)
    ends = paths.join(linked.filter("leaf").select("node", "session_id"), "node")
    sizes = linked.groupBy("session_id").agg(F.count("*").alias("n"))
    good = (F.col("status") == "rooted") & ~F.col("broken") & (F.col("first") == USER) & (F.col("last") == ASSISTANT) & (F.col("upto") > 0) & (F.col("hops") == F.col("n"))
    kept = ends.join(sizes, "session_id").filter(good).select("session_id", F.col("root").alias("kept_root"))
    begins = linked.select("node", "session_id", "own").join(paths.select("node", "upto", "root"), "node").join(kept, "session_id").filter("root = kept_root")
    said = whole.select("node", "session_id", "turn_ids").join(begins.select("node", (F.col("upto") - F.col("own")).alias("before")), "node")
    return said.select("session_id", "before", F.posexplode("turn_ids").alias("at", "turn_id")).select("session_id", (F.col("before") + F.col("at") + 1).alias("pos"), "turn_id")


def conversations(turns: DataFrame) -> DataFrame:
    """Kept messages in order with speaker role and text: (session_id, pos, turn_id, role, text)."""
    kept = rebuild(turns)
    name = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    said = turns.select("turn_id", F.element_at(name, role_code(F.col("role"))).alias("role"), "text")
    return kept.join(said, "turn_id").select("session_id", "pos", "turn_id", "role", "text")


def threads(records: DataFrame) -> DataFrame:
    """(line_id, thread, depth, status) of records (line_id, uuid, parent): the line at the root of
    each record's thread, its place in it counting from 1, and status rooted, orphan (the thread
    begins with a record whose parent is not there) or cycle (thread and depth are null).

    Defined cases. Records without uuid are left out. Of several with one uuid all are nodes; a
    parent pointer goes to the one with the lowest line_id. A blank parent is none."""
    rows = records.filter("uuid is not null and uuid <> ''").select(F.col("line_id").cast("bigint").alias("line_id"), "uuid", F.nullif("parent", F.lit("")).alias("parent"))
    owners = rows.groupBy(F.col("uuid").alias("parent")).agg(F.min("line_id").alias("up"))
    linked = rows.groupBy("line_id").agg(F.min("parent").alias("parent")).join(owners, "parent", "left")
    nodes = linked.select(F.col("line_id").alias("node"), F.when(F.col("parent").isNotNull(), F.coalesce("up", F.lit(-1))).alias("parent"), F.lit(1).cast("bigint").alias("depth"))
    nodes, _ = materialize(nodes, "nodes")
    paths = resolve(nodes, ["depth"], lambda a, b: {"depth": a["depth"] + b["depth"]})
    cycle = F.col("status") == "cycle"
    return paths.select(F.col("node").alias("line_id"), F.when(~cycle, F.col("root")).alias("thread"), F.when(~cycle, F.col("depth")).alias("depth"), "status")
