"""Queries of the log engine: search, vectors, predicates, folds, catalogue, texts, upkeep, state.

Bindings to the archive's tables: notes are documents (name from source, description from project,
mtime from doc_id), vectors are embeddings by turn_id or doc_id, alarm events are events. The archive's tools
WriteFile and Shell count like the reference's Write and Bash. The moment "now" is fixed, so
results are repeatable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.functions.instants import is_instant
from threadlake.operators import catalog, folds, ingest, maintain, search, trigrams, vectors
from threadlake.operators.incremental import VersionedTarget, good_positions, present_files
from threadlake.plans.log_sql import AS_OF, DELTA_MAX, FALLBACK, LINT, NOTE_QUERY, PHRASES, QUERY, SHORT, SQL
from threadlake.sources.ranges import listing
from threadlake.sources.tables import table
from threadlake.sources.transcripts import blocks_text, records, split_files
from threadlake.storage import broadcast_if_bounded, shared_dir, spread
from threadlake.streaming import alarm


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "turns").filter("session_id is not null")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return folds.latest_sessions(table(spark, d, "sessions"))


def recs(spark: SparkSession, d: str, holding: str | None = None) -> DataFrame:
    return records(spread(table(spark, d, "transcript_lines").select("line_id", "file_id", "line_no", "has_newline", "raw")), ["line_id", "file_id", "line_no"], holding)


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("name"), F.col("project").alias("description"), F.col("text").alias("body"), "project", F.col("doc_id").alias("mtime"))


def vecs(spark: SparkSession, d: str, key: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("vec"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def _headless(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).filter("entrypoint = 'sdk-cli'").select("session_id")


def visible(spark: SparkSession, d: str) -> DataFrame:
    """Main-thread turns of sessions that no program fed."""
    rows = turns(spark, d).filter(~F.coalesce("is_sidechain", F.lit(False)))
    return rows.join(broadcast_if_bounded(_headless(spark, d)), "session_id", "left_anti")


def _weighed(spark: SparkSession, d: str, query: str) -> DataFrame:
    hits = search.matches(turns(spark, d), query, ~F.coalesce(F.col("is_sidechain"), F.lit(False)))
    hits = hits.join(broadcast_if_bounded(_headless(spark, d)), "session_id", "left_anti")
    return search.weigh(hits, AS_OF)


# ---- retrieval


def search_ranked(spark, d):
    return search.rank_sessions(_weighed(spark, d, QUERY), sessions(spark, d))


def search_indexed(spark, d):
    """search_ranked by way of a trigram index that was built in two versions."""
    target = VersionedTarget(spark, f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}")
    rows, first = turns(spark, d), F.pmod("turn_id", F.lit(3)) == 0
    trigrams.add(target, rows.filter(first), block_rows=200)
    trigrams.add(target, rows.filter(~first), block_rows=200)
    hits = trigrams.matches(target, QUERY, ~F.coalesce(F.col("is_sidechain"), F.lit(False)))
    hits = hits.join(broadcast_if_bounded(_headless(spark, d)), "session_id", "left_anti")
    return search.rank_sessions(search.weigh(hits, AS_OF), sessions(spark, d))


def search_top_turns(spark, d):
    hits = _weighed(spark, d, QUERY)
    return search.top_turns(hits, search.rank_sessions(hits, sessions(spark, d))).select("session_id", "turn_id", "place", F.round("w", 6).alias("w"))


def bm25_scores(spark, d):
    return search.matches(turns(spark, d), QUERY).select("turn_id", F.round("bm", 6).alias("bm"))


def fallback_strategy(spark, d):
    return search.matches(turns(spark, d), FALLBACK).select("turn_id", "grade", F.round("bm", 6).alias("bm"))


def short_term_search(spark, d):
    return search.matches(turns(spark, d), SHORT).select("turn_id", "bm")


def snippet(spark, d):
    return search.matches(turns(spark, d), QUERY).select("turn_id", X.snippet(F.col("text"), PHRASES).alias("snippet"))


def memory_search(spark, d):
    return search.search_notes(notes(spark, d), NOTE_QUERY).select("note_id", "in_head", F.round("bm", 6).alias("bm"))


# ---- vectors


def vector_dot(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    return vecs(spark, d, "vec_id").select("vec_id", F.round(vectors.dot(F.col("vec"), q), 6).alias("sim"))


def semantic_sessions(spark, d):
    found = search.rank_sessions(_weighed(spark, d, QUERY), sessions(spark, d))
    return vectors.semantic_sessions(turns(spark, d), sessions(spark, d), vecs(spark, d, "turn_id"), _query_vector(spark, d), 0.05, 3, found)


def semantic_memories(spark, d):
    return vectors.semantic_notes(notes(spark, d), vecs(spark, d, "note_id"), _query_vector(spark, d), 0.05)


def embed_pending(spark, d):
    """Notes and turns that still lack a vector."""
    return vectors.worklist(turns(spark, d), sessions(spark, d), vecs(spark, d, "turn_id"), notes(spark, d), vecs(spark, d, "note_id"))


# ---- predicates


def role_filter(spark, d):
    return turns(spark, d).filter(F.col("role").isin("user", "assistant")).select("turn_id", "role")


def visibility_filter(spark, d):
    return visible(spark, d).select("turn_id")


def project_like(spark, d):
    return sessions(spark, d).filter(X.like_ascii(F.col("project"), "KIOSK")).select("session_id", "project")


def since_filter(spark, d):
    return turns(spark, d).filter((F.col("ts") >= "2026-01-01") & (F.col("ts") != "")).select("turn_id", "ts")


def sessions_grep(spark, d):
    grep = "The"
    return sessions(spark, d).filter(X.like_ascii(F.col("title"), grep) | X.like_ascii(F.col("first_user_msg"), grep)).select("session_id")


def semi_project(spark, d):
    chosen = sessions(spark, d).filter(X.like_ascii(F.col("project"), "mailer")).select("session_id")
    return turns(spark, d).join(broadcast_if_bounded(chosen), "session_id", "left_semi").select("turn_id")


def anti_headless(spark, d):
    return turns(spark, d).join(broadcast_if_bounded(_headless(spark, d)), "session_id", "left_anti").select("turn_id")


def orphans(spark, d):
    return folds.orphans(turns(spark, d), sessions(spark, d).filter("jsonl_exists")).select("turn_id")


def canary_counts(spark, d):
    rows = turns(spark, d).filter("role = 'user'")
    tests = [*X.CANARIES, ("after that", "After that"), ("the next step", "The next step")]
    counts = rows.agg(*[F.count_if(F.col("text").startswith(p)).alias(f"c{k}") for k, (_, p) in enumerate(tests)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("canary"), F.col(f"c{k}").alias("n")) for k, (n, _) in enumerate(tests)])))


# ---- folds


def _files(spark, d):
    return folds.session_files(recs(spark, d))


def session_file_fold(spark, d):
    return _files(spark, d)


def merge_state(spark, d):
    """Session files of the lines up to the tenth of each file, merged with those of a later pass
    over the rest."""
    rows = recs(spark, d)
    return folds.merge_state(folds.session_files(rows.filter("line_no <= 10")), folds.session_files(rows.filter("line_no > 10")), ["session_id", "file_id"])


def sessions_rollup(spark, d):
    rows = folds.inherit_sessions(recs(spark, d))
    return folds.sessions_rollup(folds.fold_files(rows), folds.turns_of(rows))


def _touched(spark, d):
    return folds.touches(folds.inherit_sessions(recs(spark, d)), ["session_id", "file_id", "line_no", "ts"])


def tool_uses_explode(spark, d):
    return _touched(spark, d).select("file_id", "line_no", "pos", "kind", "value")


def touches_agg(spark, d):
    return folds.touch_counts(_touched(spark, d), ["session_id", "file_id"])


def top_touches(spark, d):
    counts = folds.touch_counts(_touched(spark, d), ["session_id"])
    return catalog.top_touches(counts, ["session_id"], "tool", 2).select("session_id", "value", "n", "place")


def drift_types(spark, d):
    return folds.record_types(recs(spark, d))


def drift_blocks(spark, d):
    return folds.block_types(recs(spark, d))


def stats_totals(spark, d):
    return folds.totals(table(spark, d, "turns"), sessions(spark, d))


def busiest_projects(spark, d):
    return folds.busiest_projects(sessions(spark, d))


def duplicate_turns(spark, d):
    return folds.duplicates(turns(spark, d), ["session_id", "file_id", "seq"])


def verify_counts(spark, d):
    return folds.count_mismatches(sessions(spark, d), turns(spark, d))


def ffill_session(spark, d):
    return folds.inherit_sessions(recs(spark, d)).select("line_id", "session_id")


def blocks_text_query(spark, d):
    return recs(spark, d).filter(F.col("content").isNotNull()).select("line_id", blocks_text(F.col("content")).alias("text"))


def last_usage(spark, d):
    return folds.last_usage(recs(spark, d))


# ---- catalogue


def sessions_list(spark, d):
    return catalog.listing(sessions(spark, d)).select("session_id", "project", "title", "ended_at")


def show_ordered(spark, d):
    return catalog.numbered(catalog.shown(turns(spark, d))).select("session_id", "turn_id", "rn")


def show_context(spark, d):
    return catalog.context(catalog.shown(turns(spark, d)), 20, 2).select("session_id", "turn_id", "rn")


def show_last(spark, d):
    return catalog.tail(catalog.shown(turns(spark, d)), 5).select("session_id", "turn_id", "rn")


def show_head(spark, d):
    return catalog.head(catalog.shown(turns(spark, d)), 5).select("session_id", "turn_id", "rn")


def show_text(spark, d):
    return catalog.read(turns(spark, d), 2, last=True, line=20, most_chars=200)


def top_files(spark, d):
    counts = folds.touch_counts(_touched(spark, d), ["session_id", "file_id"])
    return catalog.top_touches(counts, ["session_id"], "file", 12).select("session_id", "file_id", "value", "n", "place")


def resolve_prefixes(spark, d):
    """The first three characters of every session id, and one that none begins with."""
    rows = sessions(spark, d)
    return catalog.resolve_all(rows, rows.select(F.substring("session_id", 1, 3).alias("prefix")).unionByName(spark.createDataFrame([("nothing",)], "prefix string")))


def sample_turns(spark, d):
    return catalog.sample(turns(spark, d), 20).select("turn_id")


def search_json(spark, d):
    """Ranked sessions as JSON texts."""
    ranked = search.rank_sessions(_weighed(spark, d, QUERY), sessions(spark, d))
    return ranked.select(F.to_json(F.struct("session_id", "hits", "best_turn", "grade")).alias("json"))


# ---- texts


def note_redact(spark, d):
    return _secret(spark, d).select("turn_id", X.clean_note(F.col("text")).alias("text"))


def note_tags(spark, d):
    return _tagged(spark, d).select("turn_id", X.strip_note_tags(F.col("text")).alias("text"))


def short_forms(spark, d):
    return turns(spark, d).select("turn_id", X.short_id(F.col("session_id")).alias("short_id"), X.shorten(F.col("text"), 40).alias("short_text"))


def embed_notes(spark, d):
    """Notes without a vector, embedded by a stand-in that counts characters."""
    todo = vectors.pending_notes(notes(spark, d), vecs(spark, d, "note_id"))
    return vectors.embed(todo, "note_id", lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]).select("note_id", F.col("vec")[0].cast("bigint").alias("chars"), F.col("vec")[1].cast("bigint").alias("es"))


def verify_roundtrip(spark, d):
    """Stored turns of sessions whose file exists against their lines."""
    alive = sessions(spark, d).filter("jsonl_exists").select("session_id")
    return folds.reextracted(turns(spark, d).join(broadcast_if_bounded(alive), "session_id", "left_semi"), recs(spark, d))


def _tagged(spark, d):
    t = F.coalesce("text", F.lit(""))
    k = F.pmod("turn_id", F.lit(4))
    built = (
        F.when(k == 0, F.concat(F.lit("<system-reminder>"), F.substring(t, 1, 20), F.lit("</system-reminder>"), t))
        .when(k == 1, F.concat(F.lit("<command-name>"), t))
        .when(k == 2, F.concat(F.lit("Caveat: The messages below\n"), t))
        .otherwise(F.concat(t, F.lit("\t  \n\n\n\n<task-notification>a</task-notification></task-notification>")))
    )
    return spread(table(spark, d, "turns").select("turn_id", "text")).select("turn_id", built.alias("text"))


def strip_tag_pairs(spark, d):
    return _tagged(spark, d).select("turn_id", X.strip_pairs(F.col("text")).alias("text"))


def collapse_ws(spark, d):
    return _tagged(spark, d).select("turn_id", X.collapse_blanks(F.col("text")).alias("text"))


def clean_text(spark, d):
    return _tagged(spark, d).select("turn_id", X.clean_text(F.col("text")).alias("text"))


def _secret(spark, d):
    """Turns with an invented credential of one of twelve shapes."""
    key = F.coalesce(F.replace("session_id", F.lit("-"), F.lit("")), F.lit("0123456789abcdef0123456789abcdef"))
    shapes = [
        [" sk-", key, " task-manager"], [' api_key = "', key, '" ok'], [" Password: ", key], [" export SOME_TENANT_KEY=", key, " MAX_TOKEN=4096"], [' "client_secret": "', key, '"'],
        [" Bearer ", key, " and Bearer token prose"], [" pk_live_", key, " go_live_date"], [" AKIA", F.upper(F.substring(key, 1, 16)), " x"], [" ghp_", key], [" xoxb-", key],
        [" eyJ", key, ".eyJ", key, ".", key], [" -----BEGIN RSA PRIVATE KEY-----\n", key, "\n-----END RSA PRIVATE KEY----- done"],
    ]
    shaped = F.array(*[F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in s]) for s in shapes])
    return spread(table(spark, d, "turns").select("turn_id", "session_id", "text")).select("turn_id", F.concat(F.coalesce("text", F.lit("")), F.get(shaped, F.pmod("turn_id", F.lit(12)).cast("int"))).alias("text"))


def redact_text(spark, d):
    return _secret(spark, d).select("turn_id", X.redact(F.col("text")).alias("text"))


def leak_audit(spark, d):
    """Exposed credentials in turns (with invented ones), in the same after masking, in notes as name,
    description and body, in titles, and in touches."""
    whole = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "description", "body")])
    sources = {"turns": _secret(spark, d), "cleaned": redact_text(spark, d), "notes": notes(spark, d).select(whole.alias("text")), "titles": table(spark, d, "sessions").select(F.col("title").alias("text"))}
    return folds.leak_audit(sources | {"touches": _touched(spark, d).select(F.col("value").alias("text"))})


def marker_hits(spark, d):
    return _secret(spark, d).select("turn_id", X.marker_hits(F.col("text")).alias("markers"))


def slugify(spark, d):
    return sessions(spark, d).select("session_id", X.slugify(F.col("cwd")).alias("slug"))


def project_for(spark, d):
    return sessions(spark, d).select("session_id", X.project_for(F.col("cwd"), F.col("jsonl_path"), "/data/desk", "/data").alias("project"))


def local_date(spark, d):
    return table(spark, d, "turns").select("turn_id", X.local_date(F.col("ts"), "Asia/Bangkok").alias("day"), X.local_stamp(F.col("ts"), "Asia/Bangkok").alias("stamp"))


def age_bucket(spark, d):
    return table(spark, d, "turns").filter(is_instant(F.col("ts"))).select("turn_id", X.age_bucket(F.floor(F.lit(AS_OF) - X.epoch_seconds(F.col("ts")))).alias("age"))


def lint_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return maintain.lint(lines.withColumn("line_no", F.col("line_no") + 1), LINT[0], LINT[1]).select("doc_id", "line_no", "hit")


def memory_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", maintain.parse_note(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id"))).alias("n")).select("doc_id", "n.*")


def write_logs(lines: DataFrame, folder: str) -> None:
    """Lines (file_id, line_no, raw, has_newline) as one log file per file_id below the folder."""
    text = F.concat(F.coalesce("raw", F.lit("")), F.when(F.col("has_newline"), "\n").otherwise(""))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda r: r["t"]), "")

    def write(batches):
        from pyarrow import fs  # noqa: PLC0415

        for b in batches:
            for k, body in zip(*[c.to_pylist() for c in b.columns]):
                system, path = fs.FileSystem.from_uri(f"{folder}/f{k}/log.jsonl")
                system.create_dir(path.rsplit("/", 1)[0])
                with system.open_output_stream(path) as out:
                    out.write(body.encode())
            yield b.slice(0, 0)

    lines.filter("file_id is not null").groupBy("file_id").agg(content.alias("body")).mapInArrow(write, "file_id bigint, body string").count()


def ingest_roundtrip(spark, d):
    """The lines written as JSON Lines files and read again; the unfinished ones stay unfinished."""
    at = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    write_logs(table(spark, d, "transcript_lines").select("file_id", "line_no", "raw", "has_newline"), at)
    read = split_files(spark, [f"{at}/*/*.jsonl"]).filter("has_newline")
    return read.select(F.regexp_extract("path", r"/f(\d+)/log", 1).cast("bigint").alias("file_id"), "line_no", "has_newline", "raw")


def ingest_incremental(spark, d):
    """The logs loaded by several runs: begun, grown, a run lost before it published, rewritten shorter
    (every seventh file), and unchanged. Every finished line is there once."""
    at = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    target = VersionedTarget(spark, f"{at}/target")
    lines = table(spark, d, "transcript_lines").select("file_id", "line_no", "raw", "has_newline").filter("file_id is not null")
    cut = (F.col("line_no") == 6) & F.col("has_newline")
    begun = lines.filter("line_no <= 6").withColumn("raw", F.when(cut, F.substring("raw", 1, 9)).otherwise(F.col("raw"))).withColumn("has_newline", F.col("has_newline") & ~cut)
    load = lambda **more: ingest.run(target, listing(spark, [f"{at}/logs/*/*.jsonl"]), **more)
    write_logs(begun, f"{at}/logs")
    load()
    write_logs(lines, f"{at}/logs")

    def lose():
        raise InterruptedError

    try:
        load(before_publish=lose)
    except InterruptedError:
        pass
    load()
    write_logs(lines.filter("file_id % 7 = 0 and line_no <= 3"), f"{at}/logs")
    last = load()
    if load() != last:
        raise AssertionError("a run without news published a version")
    return target.read().select(F.regexp_extract("path", r"/f(\d+)/log", 1).cast("bigint").alias("file_id"), "line_no", "byte_start", "raw")


# ---- upkeep


def _manifest(spark, d):
    seen = good_positions(table(spark, d, "files_seen"), table(spark, d, "scan_runs"))
    return seen.select("path", F.col("pos_size").alias("size"), F.col("pos_mtime").alias("mtime"), F.col("pos_offset").alias("offset"))


def manifest_plan(spark, d):
    return maintain.scan_plan(_manifest(spark, d), present_files(table(spark, d, "file_listing")))


def snapshot_diff(spark, d):
    return maintain.snapshot_diff(_manifest(spark, d), present_files(table(spark, d, "file_listing")), "path", ["size", "mtime"])


def _forgotten(spark, d):
    return sessions(spark, d).filter("project = 'kelp-mailer'").select("session_id")


def forget_antijoin(spark, d):
    return maintain.forget(turns(spark, d), _forgotten(spark, d)).select("turn_id")


def forget_dry_run(spark, d):
    return maintain.forget_counts({"turns": turns(spark, d), "documents": table(spark, d, "documents"), "sessions": table(spark, d, "sessions")}, _forgotten(spark, d))


def _session_paths(spark, d):
    return turns(spark, d).select("session_id", "file_id").distinct().join(table(spark, d, "files"), "file_id").select("session_id", "path")


def forget_tombstones(spark, d):
    """Files of the forgotten sessions: those still there are skipped, of the others the tombstone goes."""
    stones, present = maintain.tombstones(_session_paths(spark, d), _forgotten(spark, d)), present_files(table(spark, d, "file_listing"))
    scanned, kept = maintain.drop_tombstoned(present, stones)
    state = lambda rows, name: rows.select("path", F.lit(name).alias("state"))
    return state(scanned, "scan").unionByName(state(kept, "skip")).unionByName(state(stones.join(kept, "path", "left_anti"), "expired"))


def drop_restarted(spark, d):
    """Turns that stay when the rows of files to be read anew are dropped."""
    again = manifest_plan(spark, d).filter("action = 'restart'")
    return maintain.drop_files(turns(spark, d).join(table(spark, d, "files"), "file_id"), again).select("turn_id")


def rebuild_archive(spark, d):
    """A full rebuild: fresh lines of the files there are, and stored turns of files that are gone."""
    files, present = table(spark, d, "files"), present_files(table(spark, d, "file_listing"))
    fresh = table(spark, d, "transcript_lines").filter("has_newline").join(files, "file_id").join(present.select("path"), "path", "left_semi").select("path", F.col("line_id").alias("id"), F.lit("fresh").alias("kind"))
    archived = turns(spark, d).join(files, "file_id").select("path", F.col("turn_id").alias("id"), F.lit("archived").alias("kind"))
    return maintain.rebuild(archived, fresh, present)


def memory_folders(spark, d):
    """The nearest folder at or above each working folder in which a command-line session ran."""
    rows = sessions(spark, d).filter("cwd is not null")
    there = rows.filter("entrypoint = 'cli'").select(F.col("cwd").alias("folder"), F.lit(2).alias("root")).unionByName(rows.select(F.lit("/data/desk").alias("folder"), F.lit(1).alias("root")))
    return maintain.nearest_ancestor(rows, there)


def stale_notes(spark, d):
    """Notes older than the session that loads them after a compaction."""
    rows = table(spark, d, "documents").select("doc_id", "session_id", (F.unix_micros("captured_at") / 1e6).alias("mtime")).join(sessions(spark, d).select("session_id", X.epoch_seconds(F.col("started_at")).alias("start")), "session_id")
    return rows.filter(alarm.stale(F.lit("compact"), F.col("mtime"), F.col("start"))).select("doc_id")


def longest_prefix_project(spark, d):
    rows = sessions(spark, d)
    names = rows.filter("cwd like '/data/desk/%'").select(X.slugify(F.substring("cwd", 12, 1_000_000)).alias("slug"))
    known = rows.filter("project is not null and project <> ''").select(X.slugify(F.col("project")).alias("known_slug"), "project").groupBy("known_slug").agg(F.min("project").alias("project"))
    return maintain.longest_prefix(names, known)


# ---- state


def tier_alarm(spark, d):
    ev = table(spark, d, "events")
    return alarm.alarms(ev, "user_id", ["ts", "event_id"], alarm.wanted(F.col("value"), F.lit(140.0), F.lit(176.0))).select("event_id", "user_id", "want", "mode")


def tier_alarm_stream(spark, d):
    return _streamed(spark, d, None)


def tier_alarm_ttl(spark, d):
    """The stream whose state is forgotten six hours after the last alarm."""
    return _streamed(spark, d, 0.25)


def _streamed(spark, d, ttl_days):
    """The alarm on a stream that reads the events, its output written below the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = table(spark, d, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    at = f"{shared_dir(spark)}/alarm-{uuid.uuid4().hex}"
    out = alarm.stream_alarms(events.select("user_id", "event_id", "ts", "value"), "user_id", 140.0, 176.0, ttl_days)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").select("event_id", F.col("key").alias("user_id"), "want", "mode")


def thresholds(spark, d):
    window, tokens = (F.col("user_id") + 100) * 1000, (F.col("value") * 10000).cast("bigint")
    full, quick = alarm.thresholds(alarm.effective_window(window, tokens))
    return table(spark, d, "events").select("event_id", full.alias("full"), quick.alias("quick"))


def _dated(spark, d):
    return recs(spark, d, '"timestamp"').withColumn("epoch", X.epoch_seconds(F.col("ts"))).withColumn("is_boundary", F.coalesce(F.col("subtype") == "compact_boundary", F.lit(False)))


def cycle_start(spark, d):
    return alarm.cycle_start(_dated(spark, d), "file_id", AS_OF).select("file_id", F.round("start", 3).alias("start"))


def _since(spark, d):
    return _dated(spark, d).filter("epoch is not null").groupBy("file_id").agg((F.min("epoch") + 60.0).alias("since"))


def _delta(spark, d):
    return alarm.delta(_dated(spark, d).filter(F.col("type").isin("user", "assistant")), "file_id", _since(spark, d))


def _delta_uses(spark, d):
    return folds.delta_uses(_delta(spark, d), ["file_id", "line_no"], [*folds.EDITORS, "WriteFile"], [*folds.SHELLS, "Shell"])


def delta_counts(spark, d):
    return _delta(spark, d).groupBy("file_id").agg(F.count_if(F.col("type") == "user").alias("users"), F.count_if(F.col("type") == "assistant").alias("assistants"))


def delta_files(spark, d):
    """The last 40 files that were written or edited, by tool; reads take no places."""
    used = _delta_uses(spark, d).filter("kind = 'edit'")
    last = used.groupBy("file_id", "tool", "value").agg(F.max(F.struct("line_no", "pos")).alias("at")).select("file_id", "tool", "value", "at.line_no", "at.pos")
    return alarm.keep_last(last, "file_id", ["line_no", "pos"], 40)


def delta_messages(spark, d):
    """The last 25 messages that fit the budget, cleaned, masked and shortened."""
    said = folds.delta_messages(_delta(spark, d), ["file_id", "line_no"])
    return alarm.within_budget(alarm.keep_last(said, "file_id", ["line_no"], 25), "file_id", ["line_no"], "text", DELTA_MAX)


def delta_commands(spark, d):
    """The last 30 shell commands."""
    used = _delta_uses(spark, d).filter("kind = 'command'").select("file_id", "line_no", "pos", "value")
    return alarm.keep_last(used, "file_id", ["line_no", "pos"], 30)


def delta_report(spark, d):
    """The whole delta of each file as one text of a bounded length."""
    rows = _delta(spark, d)
    counts = rows.groupBy("file_id", "since").agg(F.count("*").alias("n_after"))
    return alarm.delta_report(folds.delta_messages(rows, ["file_id", "line_no", "epoch"]), _delta_uses(spark, d), counts, "file_id", DELTA_MAX)


def note_selection(spark, d):
    """Notes with an invented head that names their session, another one or none."""
    docs = table(spark, d, "documents").filter("session_id is not null")
    kind = F.pmod("doc_id", F.lit(3))
    named = F.when(kind == 1, F.col("session_id")).when(F.pmod("doc_id", F.lit(2)) == 0, "00000000-dead-beef")
    text = F.concat(F.lit("---\nname: x\n"), F.coalesce(F.concat(F.lit("  originSessionId: "), named, F.lit("\n")), F.lit("")), F.lit("---\n"), F.coalesce("text", F.lit("")))
    rows = docs.select("session_id", F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("mtime"), (kind == 0).alias("own"), maintain.origin_of(text).alias("origin"))
    return maintain.choose_note(rows).select("session_id", "path", "priority")


_ALL = [
    search_ranked, search_indexed, search_top_turns, bm25_scores, fallback_strategy, short_term_search, snippet, memory_search, vector_dot, semantic_sessions, semantic_memories, embed_pending,
    role_filter, visibility_filter, project_like, since_filter, sessions_grep, semi_project, anti_headless, orphans, canary_counts,
    session_file_fold, merge_state, sessions_rollup, touches_agg, tool_uses_explode, top_touches, drift_types, drift_blocks, stats_totals, busiest_projects, duplicate_turns, verify_counts, ffill_session, last_usage,
    sessions_list, show_ordered, show_context, show_last, show_head, show_text, top_files, resolve_prefixes, sample_turns, search_json,
    strip_tag_pairs, collapse_ws, clean_text, redact_text, leak_audit, marker_hits, slugify, project_for, local_date, age_bucket, lint_lines, memory_parse, note_redact, note_tags, short_forms, embed_notes, verify_roundtrip, ingest_roundtrip, ingest_incremental,
    manifest_plan, snapshot_diff, forget_antijoin, forget_dry_run, forget_tombstones, drop_restarted, rebuild_archive, memory_folders, stale_notes, longest_prefix_project,
    tier_alarm, tier_alarm_stream, tier_alarm_ttl, thresholds, cycle_start, delta_counts, delta_files, delta_messages, delta_commands, delta_report, note_selection,
]

QUERIES = {f.__name__: f for f in _ALL} | {"blocks_text": blocks_text_query}
__all__ = ["QUERIES", "SQL"]
