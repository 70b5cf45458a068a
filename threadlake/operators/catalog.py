"""Catalogue listings and windows of a conversation.

Windows are cut for many sessions at once. Places within a session come from a range-partitioned
sort and partition offsets, and the anchor of a context from a plain aggregation, so a session that
holds most turns is spread over tasks. Only narrow columns are sorted; texts are fetched by turn_id
for the few turns that are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import like_ascii
from threadlake.storage import materialize


def listing(sessions: DataFrame, limit: int = 30, project: str | None = None, since: str | None = None, grep: str | None = None) -> DataFrame:
    """Sessions, the latest first. since compares texts and never passes a missing time; grep
    looks into title and first message."""
    rows = sessions
    if project is not None:
        rows = rows.filter(like_ascii(F.col("project"), project))
    if since is not None:
        rows = rows.filter((F.col("ended_at") >= since) & (F.col("ended_at") != ""))
    if grep is not None:
        rows = rows.filter(like_ascii(F.col("title"), grep) | like_ascii(F.col("first_user_msg"), grep))
    return rows.orderBy(F.desc_nulls_last("ended_at"), "session_id").limit(limit)


def shown(turns: DataFrame) -> DataFrame:
    """Main-thread turns; of sessions that have none, the sidechain ones."""
    side = F.coalesce("is_sidechain", F.lit(False))
    main = turns.filter(~side).select("session_id").distinct().withColumn("__main", F.lit(True))
    return turns.join(main, "session_id", "left").filter(~side | F.col("__main").isNull()).drop("__main")


def numbered(turns: DataFrame) -> DataFrame:
    """(session_id, turn_id, file_id, seq, line_no, rn): rn is the turn's place in its session's
    conversation; undated turns come last, then time, file and place in it decide."""
    stamp = F.coalesce("ts", F.lit(""))
    narrow = turns.select("session_id", "turn_id", "file_id", "seq", "line_no", (stamp == "").alias("undated"), stamp.alias("ts"))
    keys = ["undated", "ts", "file_id", "seq", "turn_id"]
    ranged = narrow.repartitionByRange("session_id", *keys).withColumn("pid", F.spark_partition_id())
    ranged, _ = materialize(ranged, "order")
    counts = ranged.groupBy("session_id", "pid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("session_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("session_id", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("session_id", "pid").orderBy(*keys))
    placed = ranged.withColumn("local", local).join(offsets, ["session_id", "pid"])
    return placed.select("session_id", "turn_id", "file_id", "seq", "line_no", (F.col("before") + F.col("local")).alias("rn"))


def head(turns: DataFrame, n: int) -> DataFrame:
    return numbered(turns).filter(F.col("rn") <= n)


def tail(turns: DataFrame, n: int) -> DataFrame:
    rows = numbered(turns)
    last = rows.groupBy("session_id").agg(F.max("rn").alias("__last"))
    return rows.join(last, "session_id").filter(F.col("rn") > F.col("__last") - n).drop("__last")


def context(turns: DataFrame, line: int, around: int) -> DataFrame:
    """The turns around the one closest to a line (the first of several)."""
    rows = numbered(turns)
    anchor = rows.groupBy("session_id").agg(F.min_by("rn", F.struct(F.abs(F.col("line_no") - line), F.col("rn"))).alias("__at"))
    return rows.join(anchor, "session_id").filter(F.abs(F.col("rn") - F.col("__at")) <= around).drop("__at")


def read(turns: DataFrame, around: int = 2, every: bool = False, last: bool = False, line: int | None = None, most_chars: int = 1500) -> DataFrame:
    """(session_id, rn, turn_id, role, ts, line_no, text) of a part of each conversation: everything,
    else the end, else what stands around a line, else the beginning. Texts are cut unless
    everything is read."""
    rows, n = shown(turns), 2 * around + 1
    part = numbered(rows) if every else tail(rows, n) if last else context(rows, line, around) if line is not None else head(rows, n)
    text = F.col("text") if every else F.when(F.length("text") > most_chars, F.concat(F.substring("text", 1, most_chars), F.lit(f"\n[cut at {most_chars} characters]"))).otherwise(F.col("text"))
    return part.select("session_id", "turn_id", "rn").join(turns.select("turn_id", "role", "ts", "line_no", text.alias("text")), "turn_id").select("session_id", "rn", "turn_id", "role", "ts", "line_no", "text")


def top_touches(counts: DataFrame, keys: list[str], kind: str = "file", limit: int = 12) -> DataFrame:
    """Each key's most touched values of a kind; counts of several files of a key stay apart."""
    ties = [c for c in ("file_id",) if c in counts.columns and c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "value", *ties)
    return counts.filter(F.col("kind") == kind).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def resolve(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session ids that begin with a prefix: none, one, or several (ambiguous)."""
    return sessions.filter(F.col("session_id").startswith(prefix)).select("session_id").distinct()


def resolve_one(sessions: DataFrame, prefix: str) -> str:
    """The one session id that begins with a prefix; LookupError if there is none or several."""
    found = [r[0] for r in resolve(sessions, prefix).orderBy("session_id").limit(7).collect()]
    if len(found) != 1:
        raise LookupError(f"{prefix!r} is ambiguous: {', '.join(x.split('-')[0] for x in found[:6])}" if found else f"no session begins with {prefix!r}")
    return found[0]


def resolve_all(sessions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, matches, session_id) of many prefixes; the id only where it is the only one. Ids are
    cut to the lengths that occur and joined, not compared with every prefix."""
    wanted = prefixes.select("prefix").distinct()
    lengths = wanted.select(F.length("prefix").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))  # one row, as few as ids are long
    cut = sessions.select("session_id").distinct().join(F.broadcast(lengths)).select("session_id", F.explode("ns").alias("n")).filter(F.length("session_id") >= F.col("n"))
    found = cut.groupBy(F.substring("session_id", F.lit(1), F.col("n")).alias("prefix")).agg(F.count("*").alias("matches"), F.min("session_id").alias("session_id"))
    both = wanted.join(found, "prefix", "left")
    return both.select("prefix", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("session_id")).alias("session_id"))


def sample(turns: DataFrame, n: int) -> DataFrame:
    """A repeatable sample of n turns."""
    return turns.orderBy(F.md5(F.col("turn_id").cast("string")), "turn_id").limit(n)
