"""The two-tier threshold alarm and the delta since a watermark, on tables and on streams.

Below the lower tier a key's state is cleared; at or above it the wanted tier is 1, above the upper
one 2; an alarm is given when it rises above what was given before. On tables states are composed
over range partitions; on streams the tier is kept in state, with a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import NOTE_REDACTIONS, redact, shorten
from threadlake.storage import broadcast_if_bounded, materialize

# Tiers as shares of the window, the larger window, and how long state lives.
FULL_SHARE, QUICK_SHARE = 0.70, 0.88
LARGE_WINDOW = 1_000_000
STATE_DAYS = 7


def thresholds(window: Column, override: Column | None = None) -> tuple[Column, Column]:
    """(full, quick) tiers of a context window."""
    full = F.floor(window * FULL_SHARE).cast("bigint")
    if override is not None:
        full = F.coalesce(override.cast("bigint"), full)
    return full, F.greatest(F.floor(window * QUICK_SHARE).cast("bigint"), full + 1)


def effective_window(window: Column, tokens: Column) -> Column:
    """A reading above the window shows that the window is larger, for that reading."""
    return F.when(tokens > window, F.greatest(window, F.lit(LARGE_WINDOW))).otherwise(window)


def wanted(value: Column, full: Column, quick: Column) -> Column:
    return F.when(value >= quick, 2).when(value >= full, 1).otherwise(0)


def alarms(events: DataFrame, key: str, order: list[str], want: Column) -> DataFrame:
    """Events that raise an alarm, with ``want`` and ``mode`` (full or quick). order must tell the
    events of a key apart. Events are sorted by range partitions, so a key that has most of
    them is spread: what a partition does to the state (whether it clears it, and the highest tier
    since) is one row per key and partition, and the state a partition begins with is composed from
    the rows before."""
    ranged, _ = materialize(events.withColumn("want", want).repartitionByRange(key, *order).withColumn("pid", F.spark_partition_id()), "events")
    local = Window.partitionBy(key, "pid").orderBy(*order)
    rows = ranged.withColumn("cycle", F.sum((F.col("want") == 0).cast("int")).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "pid", "cycle").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.coalesce(F.max("want").over(inner), F.lit(0)))
    last = F.max_by(F.greatest("above", "want"), F.struct("cycle", *order))
    parts = rows.groupBy(F.col(key).alias("__k"), F.col("pid").alias("__p")).agg((F.max("cycle") > 0).alias("clears"), last.alias("tier"))
    over = Window.partitionBy("__k").orderBy("__p")
    parts = parts.withColumn("since", F.sum(F.col("clears").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("after", F.max("tier").over(Window.partitionBy("__k", "since").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.select("__k", "__p", F.coalesce(F.lag("after").over(over), F.lit(0)).alias("begins"))
    rows = rows.join(parts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("pid") == F.col("__p")))
    rows = rows.withColumn("done", F.when(F.col("cycle") == 0, F.greatest("above", "begins")).otherwise(F.col("above")))
    fired = rows.filter((F.col("want") > 0) & (F.col("want") > F.col("done")))
    return fired.withColumn("mode", F.when((F.col("want") == 1) | (F.col("done") == 0), "full").otherwise("quick")).select(*events.columns, "want", "mode")


def stream_alarms(events: DataFrame, key: str, full: float, quick: float, ttl_days: float | None = STATE_DAYS) -> DataFrame:
    """The same on a stream of (key, event_id, ts, value): (key, event_id, want, mode). Events of a
    batch are taken in the order of ts and event_id; what was given is forgotten after ttl_days of
    event time. Needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor  # noqa: PLC0415

    class Alarm(StatefulProcessor):
        def init(self, handle) -> None:
            self.tier = handle.getValueState("tier", "tier int, at double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            done, at = self.tier.get() if self.tier.exists() else (0, 0.0)
            out = []
            for event, value, ts in zip(batch["event_id"], batch["value"], batch["ts"]):
                if done and ttl_days is not None and ts.timestamp() - at > ttl_days * 86_400:
                    done = 0
                want = 2 if value >= quick else 1 if value >= full else 0
                if not want:
                    done = 0
                elif want > done:
                    out.append((key[0], event, want, "full" if want == 1 or done == 0 else "quick"))
                    done, at = want, ts.timestamp()
            if done:
                self.tier.update((int(done), float(at)))
            elif self.tier.exists():
                self.tier.clear()
            yield pd.DataFrame(out, columns=["key", "event_id", "want", "mode"])

        def close(self) -> None:
            pass

    keyed = events.select(F.col(key).cast("bigint").alias("key"), "event_id", "ts", "value")
    return keyed.groupBy("key").transformWithStateInPandas(Alarm(), "key bigint, event_id bigint, want int, mode string", "append", "none")


def cycle_start(records: DataFrame, file: str, now: float, settle: float = 600.0, line: str = "line_no") -> DataFrame:
    """(file, start): the latest compaction boundary older than settle seconds, else just before
    the first dated record in the file. records: file, line, epoch, is_boundary."""
    old = F.col("is_boundary") & (F.col("epoch") < now - settle)
    first = F.min_by("epoch", line)
    return records.filter("epoch is not null").groupBy(file).agg(F.coalesce(F.max(F.when(old, F.col("epoch"))), first - 1).alias("start"))


def delta(records: DataFrame, file: str, since: DataFrame) -> DataFrame:
    """Main-thread records after each file's watermark (column since); undated ones are out."""
    rows = records.join(broadcast_if_bounded(since), file)
    return rows.filter((F.col("epoch") > F.col("since")) & ~F.col("is_sidechain") & ~F.col("is_meta"))


def keep_last(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Each key's last n rows."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def within_budget(rows: DataFrame, key: str, order: list[str], text: str, budget: int, least: int = 3) -> DataFrame:
    """Each key's newest rows whose texts fit the budget of characters, but at least some."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__used", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("__used") <= budget) | (F.col("__rn") <= least)).drop("__rn", "__used")


def delta_report(messages: DataFrame, uses: DataFrame, counts: DataFrame, file: str, budget: int, n_messages: int = 25, n_files: int = 40, n_commands: int = 30, answer_chars: int = 2500, least: int = 3) -> DataFrame:
    """(file, n_messages, report): per file one text of what came after the watermark: messages,
    edited files, commands and the last answer, each the newest only. The oldest messages go first
    until the text fits the budget, but some stay; then the text is cut hard. messages: file,
    line_no, epoch, text; uses: see folds.delta_uses; counts: file, since, n_after. No group is
    larger than the numbers kept."""
    said = keep_last(messages, file, ["line_no"], n_messages).withColumn("line", F.concat(F.lit("  ["), F.date_format(F.timestamp_seconds("epoch"), "MM-dd HH:mm"), F.lit("] "), "text"))
    edits = uses.filter("kind = 'edit'").groupBy(file, "tool", "value").agg(F.max(F.struct("line_no", "pos")).alias("at")).select(file, F.concat(F.lit("  "), "tool", F.lit(": "), "value").alias("line"), "at.line_no", "at.pos")
    runs = uses.filter("kind = 'command'").select(file, F.concat(F.lit("  $ "), "value").alias("line"), "line_no", "pos")
    order = ["line_no", "pos"]

    def listed(rows: DataFrame, n: int, name: str) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda r: r["line"])
        return keep_last(rows, file, order, n).groupBy(file).agg(lines.alias(name))

    answers = uses.filter("kind = 'text'").groupBy(file).agg(F.max_by("value", F.struct(*order)).alias("answer"))
    newest = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("line_no", "line")))), lambda r: r["line"])
    per = counts.join(said.groupBy(file).agg(newest.alias("said")), file, "left").join(listed(edits, n_files, "edits"), file, "left").join(listed(runs, n_commands, "runs"), file, "left").join(answers, file, "left")
    some = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, "\n"))).otherwise("")
    head = F.concat(F.lit("After "), F.date_format(F.timestamp_seconds("since"), "yyyy-MM-dd HH:mm"), F.lit(": "), F.col("n_after").cast("string"), F.lit(" records"))
    tail = F.concat(some("\nFiles:\n", F.col("edits")), some("\nCommands:\n", F.col("runs")), F.when(F.col("answer").isNotNull(), F.concat(F.lit("\nLast answer:\n"), shorten(redact(F.col("answer"), NOTE_REDACTIONS), answer_chars))).otherwise(""))
    per = per.withColumn("head", head).withColumn("tail", tail).withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    room = F.lit(budget) - F.length("head") - F.length("tail") - len("\nMessages:")
    # the newest messages, while they fit or are among the few that always stay
    taken = F.aggregate("said", F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept")), lambda a, m: F.when(
        (F.size(a["kept"]) < least) | (a["used"] + F.length(m) + 1 <= room), F.struct((a["used"] + F.length(m) + 1).alias("used"), F.concat(a["kept"], F.array(m)).alias("kept"))
    ).otherwise(F.struct(F.lit(1 << 30).alias("used"), a["kept"].alias("kept"))))
    per = per.withColumn("kept", taken["kept"])
    text = F.concat("head", some("\nMessages:\n", F.reverse("kept")), "tail")
    cut = F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget), F.lit("\n[cut]"))).otherwise(text)
    return per.select(file, F.size("kept").alias("n_messages"), cut.alias("report"))


def stale(source: Column, note_mtime: Column, start: Column) -> Column:
    """Whether a note is older than the cycle that a compaction ended."""
    return (source == "compact") & (note_mtime < start)
