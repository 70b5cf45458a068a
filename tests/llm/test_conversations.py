import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadlake.llm import conversations
from threadlake.llm.pointers import resolve

TURNS = "turn_id bigint, session_id string, file_id bigint, seq bigint, role string, is_sidechain boolean, ts string, line_no bigint, text string, node string, segment string"
NAMES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "system": "system"}


def instant(ts):
    try:
        return datetime.fromisoformat(ts.replace("Z", "+00:00")) if ts and "T" in ts else None
    except ValueError:
        return None


def brute(rows):
    by = {}
    for r in rows:
        if r[1] is not None:
            key = (r[1], r[2], r[3])
            by[key] = min(by.get(key, r), r, key=lambda x: x[0])
    sessions = {}
    for (s, f, q), r in by.items():
        sessions.setdefault(s, {}).setdefault(f, []).append(r)
    out = []
    for s, files in sessions.items():
        if any(sorted((r[3] is None, r[3] or 0) for r in m) != [(False, k + 1) for k in range(len(m))] for m in files.values()):
            continue
        at = {f: min((x for x in (instant(r[6]) for r in m) if x), default=None) for f, m in files.items()}
        order = sorted(files, key=lambda f: (at[f] is None, at[f].timestamp() if at[f] else 0, f is not None, f or 0))
        said = [r for f in order for r in sorted(files[f], key=lambda r: r[3]) if not r[5]]
        roles = [NAMES.get((r[4] or "").strip().lower()) for r in said]
        if not said or None in roles or any(not (r[8] or "").strip() for r in said):
            continue
        talk = [x for x in roles if x != "system"]
        if not talk or talk[0] != "user" or talk[-1] != "assistant" or any(a == b == "user" for a, b in zip(talk, talk[1:])):
            continue
        out += [(s, k + 1, r[0]) for k, r in enumerate(said)]
    return sorted(out)


def made(seed):
    rng, rows, turn = random.Random(seed), [], 0
    for s in range(60):
        for f in range(rng.choice([1, 1, 2, 4])):
            hour = rng.randrange(0, 3)
            n = rng.choice([0, 1, 2, 4, 7, 12])
            for q in range(1, n + 1):
                turn += 1
                role = rng.choice(["user", "User ", "human"]) if q % 2 else rng.choice(["assistant", "AI", "model"])
                if rng.random() < 0.02:
                    role = rng.choice([None, "tool", "user", "assistant"])
                text = rng.choice(["", "  ", None]) if rng.random() < 0.01 else "x"
                ts = rng.choice(["n/a", None, ""]) if rng.random() < 0.3 else f"2025-01-0{1 + s % 3}T{hour:02d}:{rng.randrange(60):02d}:00{rng.choice(['Z', '+07:00', '-03:00', '.5Z'])}"
                seq = q + (rng.random() < 0.01)
                rows.append([turn, None if s == 59 else f"s{s}", s * 10 + f if s % 7 else (None if f == 0 else s * 10 + f), None if rng.random() < 0.003 else seq, "system" if rng.random() < 0.1 else role, rng.choice([None, False, False, rng.random() < 0.1]), ts, 1, text, "n", "g"])
    copies = [[turn + k + 1, *r[1:8], "other", *r[9:]] for k, r in enumerate(rng.sample(rows, 20))]
    rows = rows + copies
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(("seed", "segment"), [(1, 1024), (2, 2), (3, 3)])
def test_against_brute_force(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = made(seed)
    got = conversations.rebuild(spark.createDataFrame(rows, TURNS))
    want = brute(rows)
    assert sorted((r.session_id, r.pos, r.turn_id) for r in got.collect()) == want and want


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 16)
    rows = spark.range(1, 1001).select(
        F.col("id").alias("turn_id"), F.lit("s").alias("session_id"), F.floor((F.col("id") - 1) / 100).alias("file_id"), ((F.col("id") - 1) % 100 + 1).alias("seq"),
        F.when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.lit(False).alias("is_sidechain"),
        F.format_string("2025-01-01T%02d:00:00Z", F.floor((F.col("id") - 1) / 100)).alias("ts"), F.lit("x").alias("text"),
    )
    got = sorted((r.pos, r.turn_id) for r in conversations.rebuild(rows).collect())
    assert got == [(k, k) for k in range(1, 1001)]
    assert conversations.rebuild(rows.filter("turn_id <> 500")).count() == 0


def test_empty_and_text(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.rebuild(empty).count() == 0
    rows = [(1, "s", 1, 1, " HUMAN", False, None, 1, "a" * 2_000_000, "", ""), (2, "s", 1, 2, "Model\t", None, None, 1, "b", "", ""), (3, "t", 1, 1, "assistant", False, None, 1, "b", "", "")]
    got = conversations.conversations(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.pos, r.role, len(r.text)) for r in got) == [(1, "user", 2_000_000), (2, "assistant", 1)]


def test_pointers(spark):
    """A chain, a tree, a missing parent and a cycle."""
    rows = [(k, k - 1 if k > 1 else None) for k in range(1, 71)] + [(100, 5), (101, 5), (200, 999), (201, 200), (300, 302), (301, 300), (302, 301), (400, 400), (401, 400)]
    nodes = spark.createDataFrame(rows, "node bigint, parent bigint").withColumn("hops", F.lit(1).cast("bigint"))
    got = {r.node: (r.root, r.status, r.hops) for r in resolve(nodes, ["hops"], lambda a, b: {"hops": a["hops"] + b["hops"]}).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == (1, "rooted", k) for k in range(1, 71)) and got[100] == (1, "rooted", 6) and got[101] == (1, "rooted", 6)
    assert got[200] == (200, "orphan", 1) and got[201] == (200, "orphan", 2)
    assert {got[k][1] for k in (300, 301, 302, 400, 401)} == {"cycle"}


def test_threads(spark):
    rows = [(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "d", "gone"), (5, "e", "d"), (6, "x", "y"), (7, "y", "x"), (8, "z", "y"), (9, "s", "s"), (10, None, "a"), (11, "b", "a"), (12, "f", ""), (13, "", "a")]
    got = {r.line_id: (r.thread, r.depth, r.status) for r in conversations.threads(spark.createDataFrame(rows, "line_id bigint, uuid string, parent string")).collect()}
    assert got == {
        1: (1, 1, "rooted"), 2: (1, 2, "rooted"), 3: (1, 3, "rooted"), 4: (4, 1, "orphan"), 5: (4, 2, "orphan"), 6: (None, None, "cycle"), 7: (None, None, "cycle"), 8: (None, None, "cycle"),
        9: (None, None, "cycle"), 11: (1, 2, "rooted"), 12: (12, 1, "rooted"),
    }
    assert conversations.threads(spark.createDataFrame([], "line_id bigint, uuid string, parent string")).count() == 0


def test_copies_of_one_message(spark):
    """A message that is most of the table is cut down before it is shuffled."""

    rows = spark.range(20_000).select((F.col("id") + 10).alias("turn_id"), F.lit("s").alias("session_id"), F.lit(1).alias("file_id"), F.lit(1).alias("seq"), F.lit("user").alias("role"), F.lit(False).alias("is_sidechain"), F.lit(None).cast("string").alias("ts"), F.lit(1).alias("line_no"), F.lit("q").alias("text"))
    other = rows.filter("turn_id = 10").withColumn("turn_id", F.lit(5)).withColumn("seq", F.lit(2)).withColumn("role", F.lit("ai"))
    table = rows.unionByName(other)
    assert sorted(tuple(r) for r in conversations.rebuild(table).collect()) == [("s", 1, 10), ("s", 2, 5)]
    partial = conversations._messages(table)
    assert partial.count() == 2
