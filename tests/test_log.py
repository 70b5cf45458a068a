import datetime
import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import verify

from threadlake.functions import text as X
from threadlake.operators import catalog, folds, maintain, search, trigrams, vectors
from threadlake.operators.incremental import VersionedTarget
from threadlake.plans import log_queries
from threadlake.sources import transcripts
from threadlake.streaming import alarm

TURNS = "turn_id bigint, session_id string, file_id bigint, seq bigint, line_no bigint, role string, is_sidechain boolean, ts string, text string"
NOW = datetime.datetime(2025, 6, 1, tzinfo=datetime.timezone.utc).timestamp()


def turns(spark):
    t = "2025-05-31T00:00:00Z"
    rows = [
        (1, "a", 1, 1, 1, "user", False, t, "the Queue is stale; queue!"), (2, "a", 1, 2, 2, "assistant", False, None, "ledger and queue"), (3, "b", 2, 1, 1, "user", True, t, "queue ledger"),
        (4, "c", 3, 1, 1, "user", False, "2024-01-01T00:00:00Z", "aaaa ledger"), (5, "d", 4, 1, 1, "user", False, "", None), (6, "e", 5, 1, 1, "user", False, t, ""),
    ]
    return spark.createDataFrame(rows, TURNS)


def test_terms():
    assert search.terms("""a "b c" 'd e' don't 'x" """) == ["a", "b c", "d e", "don't", "'x"]
    assert search.split_terms('ab abc "d e"') == (["abc", "d e"], ["ab"])


def test_bm25_by_hand(spark):
    got = {r.turn_id: r.bm for r in search.matches(turns(spark), "aaa").collect()}
    size = [max(len(x or "") - 2, 0) for x in ("the Queue is stale; queue!", "ledger and queue", "queue ledger", "aaaa ledger", None, "")]
    idf = math.log((6 - 1 + 0.5) / 1.5)
    assert got == {4: pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 9 / (sum(size) / 6))))}


def test_grades(spark):
    ids = lambda q: {(r.turn_id, r.grade) for r in search.matches(turns(spark), q).collect()}
    assert ids("queue ledger") == {(2, 1), (3, 1)}
    assert ids("queue not-there-at-all") == {(1, 2), (2, 2), (3, 2)}
    assert ids("not-there stale aaaa") == {(1, 3), (4, 3)}
    assert ids("aa") == {(4, 1)} and ids("zzz") == set() and ids('""') == set()
    assert search.matches(turns(spark).limit(0), "queue").count() == 0


def test_ranking(spark):
    sessions = spark.createDataFrame([("a",), ("c",), ("a",)], "session_id string")
    hits = search.weigh(search.matches(turns(spark), "ledger", ~F.col("is_sidechain")), NOW)
    ranked = search.rank_sessions(hits, sessions).collect()
    assert [(r.session_id, r.hits, r.best_turn) for r in ranked] == [("c", 1, 4), ("a", 1, 2)] or [r.session_id for r in ranked] == ["a", "c"]
    assert search.top_turns(hits, search.rank_sessions(hits, sessions), 1).count() == 2


def test_trigram_index(spark, tmp_path):
    """The same matches as by reading everything, from the blocks that can match only."""
    rng = random.Random(7)
    words = ["Queue", "ledger", "snapshot", "ไทยคำ", "naïve", "aaaa", "x"]
    rows = [(k, "s%d" % (k % 9), 1, k, k, "user", k % 11 == 0, "2025-05-31T00:00:00Z", None if k % 50 == 0 else " ".join(rng.choice(words[:2] if k < 300 else words) for _ in range(rng.randrange(6)))) for k in range(600)]
    table = spark.createDataFrame(rows, TURNS).coalesce(2)
    target = VersionedTarget(spark, f"{tmp_path}/index")
    assert trigrams.matches(target, "queue") is None
    trigrams.add(target, table.filter("turn_id < 300"), block_rows=40)
    trigrams.add(target, table.filter("turn_id >= 300"), block_rows=40)
    plain = lambda df: sorted((r.turn_id, r.grade, round(r.bm, 9)) for r in df.collect())
    for q in ("snapshot", "QUEUE ledger", "ไทย", "naïve aaaa", "zzzz", "aaa x", "x", "ledger not-there"):
        assert plain(trigrams.matches(target, q)) == plain(search.matches(table, q)), q
    n = lambda q: trigrams.candidates(target.keys(), [q]).count()
    assert 0 < n("snapshot") < n("ledger") and n("zzzz") == 0
    old = trigrams.candidates(target.keys(), ["snapshot"])
    trigrams.add(target, table.limit(0), retired=old)
    assert plain(trigrams.matches(target, "snapshot")) == []


def test_notes(spark):
    rows = [(1, "queue", None, "x", 1), (2, "n", "d", "queue queue", 2), (3, "n", "d", "queue queue", 3), (4, None, None, None, 4)]
    notes = spark.createDataFrame(rows, "note_id bigint, name string, description string, body string, mtime bigint")
    assert [r.note_id for r in search.search_notes(notes, "queue").collect()] == [1, 3, 2]
    assert search.search_notes(notes, "qu").count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0]), (4, None), (6, [1.0])], "turn_id bigint, vec array<float>")
    sessions = spark.createDataFrame([("a", None), ("b", None), ("c", "sdk-cli")], "session_id string, entrypoint string")
    assert [tuple(r) for r in vectors.semantic_sessions(turns(spark), sessions, v, [1.0, 0.0], 0.5).collect()] == [("a", 1.0, 1)]
    done = vectors.embed(turns(spark).filter("text <> ''"), "turn_id", lambda x: [[float(len(t))] for t in x], batch=2)
    assert {r.turn_id: r.vec[0] for r in done.collect()}[2] == 16.0
    assert {r.turn_id for r in vectors.pending(turns(spark), sessions, v, least_chars=3).collect()} == set()


def record(kind, session=None, **more):
    return json.dumps({"type": kind, **({"sessionId": session} if session else {}), **more})


def lines(spark):
    said = lambda role, content, **m: {"message": {"role": role, "content": content, **m}}
    raw = [
        record("user", None, **said("user", "before any id")),
        record("ai-title", "s1", aiTitle="auto"),
        record("user", "s1", cwd="/d/app", timestamp="2025-01-01T00:00:00Z", **said("user", "<skip> me")),
        record("user", None, isMeta=True, **said("user", "meta")),
        record("user", None, timestamp="2025-01-01T00:01:00Z", **said("user", [{"type": "text", "text": "first"}, {"type": "text"}, {"type": "image"}])),
        record("assistant", None, cwd="/d/new", timestamp="2025-01-01T00:02:00Z", **said("assistant", [{"type": "tool_use", "name": "Shell", "input": {"command": "api_key=abcdefgh run", "file_path": "f"}}, {"type": "odd"}], usage={"input_tokens": 5, "iterations": [{"type": "message", "input_tokens": 7}, {"type": "other", "input_tokens": 9}]})),
        "{broken",
        record("custom-title", None, customTitle="by hand"),
        record("assistant", "s2", isSidechain=True, **said("assistant", "aside", usage={"input_tokens": 99})),
        '{"type":"mode"} null',
    ]
    rows = [(k, 1, k + 1, True, r) for k, r in enumerate(raw)] + [(99, 1, 99, False, record("user", "s1"))]
    return spark.createDataFrame(rows, "line_id bigint, file_id bigint, line_no bigint, has_newline boolean, raw string")


def test_folds(spark):
    recs = transcripts.records(lines(spark), ["line_id", "file_id", "line_no"]).cache()
    assert {r.line_id: r.session_id for r in folds.inherit_sessions(recs).collect()} == {1: "s1", 2: "s1", 4: "s1", 5: "s1", 7: "s1", 8: "s2"}
    f = {r.session_id: r for r in folds.session_files(recs).collect()}
    assert (f["s1"].title, f["s1"].cwd, f["s1"].first_user_msg, f["s1"].started_at, f["s1"].ended_at) == ("by hand", "/d/new", "first", "2025-01-01T00:00:00Z", "2025-01-01T00:02:00Z")
    total = {r.session_id: (r.n_user, r.n_assistant, r.chars_text) for r in folds.sessions_rollup(folds.session_files(recs), folds.turns_of(folds.inherit_sessions(recs))).collect()}
    assert total == {"s1": (2, 0, 14), "s2": (0, 1, 5)}
    used = folds.touches(recs, ["file_id", "line_no", "ts"])
    assert {(r.kind, r.value) for r in used.collect()} == {("tool", "Shell"), ("file", "f"), ("command", "api_key=[REDACTED] run")}
    assert folds.touch_counts(used, ["file_id"]).count() == 3
    assert {(r.kind, r.known) for r in folds.block_types(recs).collect()} >= {("odd", False), ("text", True)}
    assert {r.kind for r in folds.record_types(recs).collect()} == {"user", "ai-title", "assistant", "custom-title"}
    assert [(r.line_no, r.tokens) for r in folds.last_usage(recs).collect()] == [(6, 7)]
    merged = folds.merge_state(folds.session_files(recs.filter("line_no <= 3")), folds.session_files(recs.filter("line_no > 3").withColumn("own_session", F.coalesce("own_session", F.lit("s1")))), ["session_id", "file_id"])
    assert {r.session_id: (r.cwd, r.title, r.ended_at) for r in merged.collect()}["s1"] == ("/d/new", "by hand", "2025-01-01T00:02:00Z")
    assert folds.session_files(recs.limit(0)).count() == 0


def test_text_is_cleaned_on_its_way_and_nothing_secret_comes_out(spark, tmp_path):
    """Planted tags and credentials; every query that gives texts agrees with its SQL and leaks none."""
    key = "Zx" + "9k" * 12
    say = lambda role, text, **m: record(role, "s1", timestamp=f"2025-01-01T0{m.pop('h', 1)}:00:00Z", message={"role": role, "content": text}, **m)
    use = lambda c: [{"type": "tool_use", "name": "Bash", "input": {"command": c}}, {"type": "text", "text": f"done with api_key={key}"}]
    raw = [
        say("user", "<system-reminder>x</system-reminder>  a"), say("user", f"<command-name>/go</command-name> sk-{key}", h=2), say("user", f"use password={key} now\n\n\n\nplease", h=3),
        record("custom-title", "s1", customTitle=f"token: {key}"), record("ai-title", "s1", agentName="no"), record("mode", "s1", cwd="/not/this", timestamp="2030-01-01T00:00:00Z"),
        say("user", "[Request interrupted by user]", h=4), say("assistant", use(f"export A_KEY={key}; ls " + "x" * 400), h=5), say("user", "Caveat: The messages below are odd\nreal", h=6), say("user", "piped in", h=7, entrypoint="sdk-cli"),
        *[say("user", f"{k} " + "m" * 1600, h=8) for k in range(30)],
    ]
    spark.createDataFrame([(k, 1, k + 1, True, r) for k, r in enumerate(raw)], "line_id bigint, file_id bigint, line_no bigint, has_newline boolean, raw string").write.parquet(f"{tmp_path}/transcript_lines.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW transcript_lines AS SELECT * FROM read_parquet('{tmp_path}/transcript_lines.parquet/*.parquet')")
    for name in ("session_file_fold", "merge_state", "sessions_rollup", "delta_messages", "delta_commands", "delta_report"):
        said = verify.compare(spark, con, str(tmp_path), name, entry.oracle_sql()[name])
        assert said.startswith("same"), (name, said)
        assert key not in str(log_queries.QUERIES[name](spark, str(tmp_path)).collect()), name
    fold = log_queries.session_file_fold(spark, str(tmp_path)).first()
    assert (fold.title, fold.title_custom, fold.cwd, fold.first_user_msg) == ("token: [REDACTED]", True, None, "[REDACTED]")
    report = log_queries.delta_report(spark, str(tmp_path)).first()
    assert len(report.report) <= 14_000 and report.n_messages == 8 and "[Request" not in report.report


def test_sessions_carry_over_partitions(spark):
    """A file longer than a range partition, and one without any session."""
    rows = [(1, n, "s%d" % (n // 100) if n % 100 == 50 else None, False) for n in range(3000)] + [(2, n, None, False) for n in range(5)] + [(None, 1, "z", False), (None, 2, None, False), (None, 3, None, True)]
    recs = spark.createDataFrame(rows, "file_id bigint, line_no bigint, own_session string, is_meta boolean").repartition(4)
    got = {(r.file_id, r.line_no): r.session_id for r in folds.inherit_sessions(recs).collect()}
    assert got == {(1, n): f"s{(n - 50) // 100}" for n in range(50, 3000)} | {(None, 1): "z", (None, 2): "z"}


def test_audits(spark):
    sessions = spark.createDataFrame([("a", 5), ("b", 1), ("x", None)], "session_id string, n_user bigint")
    assert {(r.session_id, r.stored, r.counted) for r in folds.count_mismatches(sessions, turns(spark)).collect()} == {("a", 5, 1), ("x", None, 0)}
    assert {r.turn_id for r in folds.orphans(turns(spark), sessions).collect()} == {4, 5, 6}
    assert folds.duplicates(turns(spark).unionAll(turns(spark)), ["turn_id"]).count() == 6
    assert [tuple(r) for r in folds.leak_audit({"t": spark.createDataFrame([("password=x",), (None,)], "text string")}).collect()] == [("t", 1)]


def test_windows(spark):
    rows = catalog.shown(turns(spark))
    assert {r.session_id for r in rows.collect()} == {"a", "b", "c", "d", "e"}
    assert {(r.session_id, r.turn_id) for r in catalog.tail(rows, 1).collect()} >= {("a", 2), ("b", 3)}
    assert {(r.session_id, r.turn_id) for r in catalog.head(rows, 1).collect()} >= {("a", 1)}
    assert {r.turn_id for r in catalog.context(rows.filter("session_id = 'a'"), 2, 0).collect()} == {2}
    with pytest.raises(LookupError, match="ambiguous"):
        catalog.resolve_one(turns(spark), "")
    with pytest.raises(LookupError, match="no session"):
        catalog.resolve_one(turns(spark), "nope")
    assert catalog.resolve_one(turns(spark), "a") == "a"
    parts = [catalog.read(turns(spark), 0, **how).count() for how in ({"every": True, "last": True}, {"last": True, "line": 1}, {"line": 2}, {})]
    assert parts == [6, 5, 5, 5] and {r.text for r in catalog.read(turns(spark), 0, most_chars=3).collect()} >= {"the\n[cut at 3 characters]", None, ""}
    assert catalog.resolve(turns(spark), "a").count() == 1 and catalog.sample(turns(spark), 2).count() == 2


def test_one_session_with_most_turns(spark):
    rows = spark.range(4000).select(F.col("id").alias("turn_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id"))).otherwise("hot").alias("session_id"), F.lit(1).alias("file_id"), (-F.col("id")).alias("seq"), F.col("id").alias("line_no"), F.lit("t").alias("ts"))
    got = sorted((r.rn, r.turn_id) for r in catalog.numbered(rows.repartition(5)).filter("session_id = 'hot'").collect())
    assert got == [(k + 1, t) for k, t in enumerate(t for t in range(3999, -1, -1) if t % 10)]


def test_upkeep(spark):
    manifest = spark.createDataFrame([("same", 10, 5.0, 10), ("more", 10, 5.0, 10), ("less", 10, 5.0, 10), ("old", 10, 9.0, 10)], "path string, size bigint, mtime double, offset bigint")
    present = spark.createDataFrame([("same", 10, 5.0), ("more", 12, 5.0), ("less", 9, 5.0), ("old", 12, 5.0), ("new", 1, 1.0)], "path string, size bigint, mtime double")
    plan = {r.path: (r.action, r.from_offset) for r in maintain.scan_plan(manifest, present).collect()}
    assert plan == {"same": ("skip", 0), "more": ("append", 10), "less": ("restart", 0), "old": ("restart", 0), "new": ("restart", 0)}
    diff = {r.path: r.action for r in maintain.snapshot_diff(manifest.filter("path <> 'less'"), present.filter("path <> 'old'"), "path", ["size", "mtime"]).collect()}
    assert diff == {"same": "same", "more": "change", "old": "delete", "less": "add", "new": "add"}
    keep, stones = maintain.drop_tombstoned(present, spark.createDataFrame([("new",), ("gone",)], "path string"))
    assert keep.count() == 4 and [r.path for r in stones.collect()] == ["new"]
    assert {r.path for r in maintain.rebuild(manifest, present.filter("path = 'new'"), present.filter("path <> 'less'")).collect()} == {"new", "less"}
    names = spark.createDataFrame([("app-src",), ("app",), ("application",), ("a-b-c",)], "slug string")
    known = spark.createDataFrame([("app", "App"), ("a", "A"), ("a-b", "AB")], "known_slug string, project string")
    assert {r.slug: r.project for r in maintain.longest_prefix(names, known).collect()} == {"app-src": "App", "app": "App", "a-b-c": "AB"}
    folders = spark.createDataFrame([("/x/y/z",), ("/q",)], "cwd string")
    assert [tuple(r) for r in maintain.nearest_ancestor(folders, spark.createDataFrame([("/x",), ("/x/y",)], "folder string")).collect()] == [("/x/y/z", "/x/y")]


def test_note_parsing(spark):
    texts = ['---\nname: "A \\"b\\""\ndescription: one\nmeta:\n  type: kind\n type: other\nname:\n---\n\n body ', "plain", "---\nname: x\nno end", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(maintain.parse_note(F.col("t"), F.lit("stem"))).collect()]
    assert got == [('A "b"', "one", "kind", "body"), ("stem", "", "", "plain"), ("stem", "", "", "---\nname: x\nno end"), ("stem", "", "", "")]


def test_files(spark, tmp_path):
    os.makedirs(tmp_path / "r/p/s/subagents")
    os.makedirs(tmp_path / "r/p/memory")
    (tmp_path / "r/p/a.jsonl").write_bytes("{}\n\nüx\ntail".encode())
    (tmp_path / "r/p/s/subagents/agent-1.jsonl").write_text("{}\n")
    for n in ("MEMORY.md", "session_resume_1.md", "tip.md"):
        (tmp_path / "r/p/memory" / n).write_text("text")
    got = sorted((r.line_no, r.has_newline, r.raw) for r in transcripts.read_lines(spark, [f"file://{tmp_path}/r"]).collect())
    assert got == [(1, True, "{}"), (1, True, "{}"), (2, True, ""), (3, True, "üx"), (4, False, "tail")]
    assert [r.stem for r in transcripts.read_notes(spark, [f"file://{tmp_path}/r"]).collect()] == ["tip"]
    assert transcripts.read_lines(spark, [f"file://{tmp_path}/none"]).count() == 0
    assert transcripts.roots("a/", "b", "a", " ") == ["a", "b"]


def machine(events, full, quick):
    state, out = {}, []
    for e, k, v in events:
        want = 2 if v >= quick else 1 if v >= full else 0
        if want > state.get(k, 0):
            out.append((e, "full" if want == 1 or not state.get(k, 0) else "quick"))
        state[k] = 0 if not want else max(want, state.get(k, 0))
    return out


def test_alarm(spark):
    events = [(n, n % 2, v) for n, v in enumerate([1, 5, 7, 7, 9, 9, 1, 9, 9, 7, 1, 1, 7, 9, 9, 7, 1, 9])]
    df = spark.createDataFrame(events, "event_id bigint, k bigint, value bigint")
    got = alarm.alarms(df, "k", ["event_id"], alarm.wanted(F.col("value"), F.lit(7), F.lit(9)))
    assert sorted((r.event_id, r.mode) for r in got.collect()) == machine(events, 7, 9)
    rng = random.Random(3)
    many = [(n, 0 if n % 7 else n % 3, rng.choice([1, 7, 7, 7, 9]) if n < 4000 else 7) for n in range(6000)]
    spread = spark.createDataFrame(many, "event_id bigint, k bigint, value bigint").repartition(6)
    got = alarm.alarms(spread, "k", ["event_id"], alarm.wanted(F.col("value"), F.lit(7), F.lit(9)))
    assert sorted((r.event_id, r.mode) for r in got.collect()) == machine(many, 7, 9)  # one key over all partitions
    tiers = spark.range(1).select(*alarm.thresholds(alarm.effective_window(F.lit(200_000), F.lit(300_000))), *alarm.thresholds(F.lit(10), F.lit(9)))
    assert tuple(tiers.first()) == (700_000, 880_000, 9, 10)


def test_alarm_stream_over_batches(spark, tmp_path):
    """State lives on between micro-batches and after a restart, and is forgotten with age."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = datetime.datetime(2025, 1, 1)
    first = [(1, 7, base, 150.0), (2, 7, base + datetime.timedelta(hours=1), 150.0)]
    second = [(3, 7, base + datetime.timedelta(hours=2), 180.0), (4, 7, base + datetime.timedelta(days=20), 150.0)]
    schema = "event_id bigint, user_id bigint, ts timestamp, value double"
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = alarm.stream_alarms(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user_id", 140.0, 176.0)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("event_id", "want", "mode").collect())
    assert got == [(1, 1, "full"), (3, 2, "quick"), (4, 1, "full")]


def test_delta(spark):
    rows = [(1, 1, 0.0, False, False, False), (1, 2, 10.0, True, False, False), (1, 3, 20.0, False, False, False), (1, 4, None, False, False, False), (1, 5, 21.0, False, True, False)]
    df = spark.createDataFrame(rows, "f int, line int, epoch double, is_boundary boolean, is_sidechain boolean, is_meta boolean")
    assert [tuple(r) for r in alarm.cycle_start(df, "f", 1000.0, line="line").collect()] == [(1, 10.0)]
    assert [tuple(r) for r in alarm.cycle_start(df, "f", 600.0, line="line").collect()] == [(1, -1.0)]
    assert [r.line for r in alarm.delta(df, "f", spark.createDataFrame([(1, 10.0)], "f int, since double")).collect()] == [3]
    texts = df.withColumn("t", F.lit("xxxx"))
    assert sorted(r.line for r in alarm.within_budget(texts, "f", ["line"], "t", 8, 1).collect()) == [4, 5]
    assert sorted(r.line for r in alarm.keep_last(texts, "f", ["line"], 2).collect()) == [4, 5]
    notes = spark.createDataFrame([("s", "a", 9, False, "other"), ("s", "b", 1, False, "s"), ("s", "c", 5, False, None), ("t", "d", 1, False, "s")], "session_id string, path string, mtime int, own boolean, origin string")
    assert [(r.session_id, r.path) for r in maintain.choose_note(notes).collect()] == [("s", "b")]
    cases = [(s, n, b) for s in ("compact", "resume") for n, b in ((1, 2), (2, 1), (2, 2))]
    stale = spark.createDataFrame(cases, "s string, n int, b int").select("s", "n", "b", alarm.stale(F.col("s"), F.col("n"), F.col("b")).alias("x"))
    assert {tuple(r[:3]) for r in stale.collect() if r.x} == {("compact", 1, 2)}


def test_delta_of_edits_and_commands(spark):
    """Reads take no places of edits, a budget of 14,000 keeps what 600 drops, commands are there."""
    use = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    said = [("user", "m" * 500)] * 5
    done = [("assistant", [use("Edit", file_path=f"/e{k}"), *[use("Read", file_path=f"/r{k}-{j}") for j in range(3)], use("Bash", command=f"run  {k}\n" + "x" * 400), use("NotebookEdit", notebook_path="/n")]) for k in range(35)]
    rows = [(1, 1, n, True, json.dumps({"type": t, "sessionId": "s", "timestamp": f"2025-01-01T{n // 60 + 1:02}:{n % 60:02}:00Z", "message": {"role": t, "content": c}})) for n, (t, c) in enumerate([("user", "start"), ("user", "soon"), *said, *done])]
    lines = spark.createDataFrame(rows, "line_id bigint, file_id bigint, line_no bigint, has_newline boolean, raw string")
    recs = transcripts.records(lines, ["line_id", "file_id", "line_no"])
    used = folds.delta_uses(recs, ["file_id", "line_no"]).collect()
    assert sum(r.kind == "edit" for r in used) == 70 and not [r for r in used if r.value.startswith("/r")]
    command = next(r.value for r in used if r.kind == "command")
    assert command.startswith("run 0 x") and command.endswith(" ...[+106 chars]")


def test_delta_queries_are_whole(spark, tmp_path):
    use = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    records = [("user", "start"), ("user", "soon"), *[("user", "m" * 500)] * 5]
    records += [("assistant", [use("Edit", file_path=f"/e{k}"), *[use("Read", file_path=f"/r{k}-{j}") for j in range(3)], use("Bash", command=f"run {k}")]) for k in range(35)]
    rows = [(n, 1, n, True, json.dumps({"type": t, "sessionId": "s", "timestamp": f"2025-01-01T{n // 60 + 1:02}:{n % 60:02}:00Z", "message": {"role": t, "content": c}})) for n, (t, c) in enumerate(records)]
    spark.createDataFrame(rows, "line_id bigint, file_id bigint, line_no bigint, has_newline boolean, raw string").write.parquet(f"{tmp_path}/transcript_lines.parquet")
    q = log_queries.QUERIES
    assert q["delta_messages"](spark, str(tmp_path)).count() == 5
    assert {r.value for r in q["delta_files"](spark, str(tmp_path)).collect()} == {f"/e{k}" for k in range(35)}
    assert sorted(r.value for r in q["delta_commands"](spark, str(tmp_path)).collect()) == sorted(f"run {k}" for k in range(5, 35))


def test_embedding_worklist_has_notes(spark):
    sessions = spark.createDataFrame([("a", "")], "session_id string, entrypoint string")
    rows = turns(spark).withColumn("text", F.rpad("text", 50, "-"))
    notes = spark.createDataFrame([(7, "n", "d", "b" * 3000), (8, None, "d", "b"), (9, "n", "d", "b")], "note_id bigint, name string, description string, body string")
    have = lambda k, key: spark.createDataFrame([(k,)], f"{key} bigint")
    got = vectors.worklist(rows, sessions, have(1, "turn_id"), notes, have(9, "note_id"))
    texts = {(r.kind, r.id): r.text for r in got.collect()}
    assert set(texts) == {("m", 7), ("m", 8), ("t", 2)} and texts["m", 8] == "\nd\nb" and len(texts["m", 7]) == 2000
    capped = vectors.worklist(rows, sessions, have(1, "turn_id"), notes, have(9, "note_id"), cap=2)
    assert {r.kind for r in capped.collect()} == {"m"}


def test_leak_audit_reads_touches_and_heads_of_notes(spark, tmp_path):
    block = {"type": "tool_use", "name": "Shell", "input": {"command": "cat -----BEGIN PRIVATE KEY----- abc", "file_path": "/a"}}
    raw = json.dumps({"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": [block]}})
    tables = {
        "transcript_lines": ([(1, 1, 1, True, raw)], "line_id bigint, file_id bigint, line_no bigint, has_newline boolean, raw string"),
        "documents": ([(1, "plain", "n", "password=hunter22"), (2, "plain", "ghp_" + "a" * 30, None), (3, "plain", "n", None)], "doc_id bigint, text string, source string, project string"),
        "turns": ([(1, "s", "plain")], "turn_id bigint, session_id string, text string"),
        "sessions": ([("plain",)], "title string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.source: r.n for r in log_queries.QUERIES["leak_audit"](spark, str(tmp_path)).collect()}
    assert got == {"turns": 1, "cleaned": 0, "notes": 2, "titles": 0, "touches": 1}
