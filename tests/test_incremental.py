import datetime

import pytest

from threadlake.operators import incremental as inc
from threadlake.operators import ingest
from threadlake.operators.incremental import VersionedTarget
from threadlake.sources import ranges
from threadlake.storage import shared_dir

DAY = datetime.datetime(2026, 1, 1)


def tables(spark, listing, seen, lines, runs=((1, "ok"), (2, "failed"), (3, "OK"))):
    files = spark.createDataFrame([(k, f"p{k}", "x") for k in range(1, 20)] + [(None, None, "x")], "file_id bigint, path string, size string")
    return (
        spark.createDataFrame(lines, "line_id bigint, file_id bigint, byte_start bigint, has_newline boolean"),
        files,
        spark.createDataFrame(listing, "path string, size bigint, mtime double, listed_at timestamp"),
        spark.createDataFrame(seen, "path string, size bigint, mtime double, offset bigint, last_scan timestamp, run_id bigint"),
        spark.createDataFrame(list(runs), "run_id bigint, status string"),
    )


def lines_of(k, n=4, step=10):
    return [(k * 100 + i, k, i * step, True) for i in range(n)] + [(k * 100 + n, k, n * step, False)]


def test_pending_lines(spark, monkeypatch):
    monkeypatch.setattr(inc, "CHUNK_BYTES", 15)
    d = [DAY + datetime.timedelta(days=k) for k in range(5)]
    listing = [(f"p{k}", 45, 1000.0, d[1]) for k in range(1, 12)] + [("p1", 5, 0.0, d[0]), ("p1", 45, 1000.0, d[1]), (None, 1, 1.0, d[0])]
    seen = [
        ("p2", 20, 1000.0, 20, d[0], 1),  # appended: from 20
        ("p3", 50, 1000.0, 20, d[0], 1),  # shrunk: all
        ("p4", 20, 1002.0, 20, d[0], 1),  # older than its position: all
        ("p5", 45, 998.0, 45, d[0], 1),  # same size, newer: all
        ("p6", 45, 1000.5, 45, d[0], 1),  # unchanged: none
        ("p7", 20, 1000.0, 21, d[0], 1),  # offset inside a line: all
        ("p8", 20, 1000.0, 20, d[0], 2),  # only a failed run: all
        ("p9", 20, 1000.0, 10, d[0], 1), ("p9", 20, 1000.0, 20, d[0], 3), ("p9", 20, 1000.0, 30, d[2], 3), ("p9", 20, 1000.0, 40, d[3], 2), ("p9", 20, 1000.0, 30, d[2], 3),
        ("p10", 20, 1000.0, 0, d[0], 1),  # at 0: all
        ("p11", None, None, 20, d[0], 1),  # unusable position: all
        ("gone", 1, 1.0, 1, d[0], 1), (None, 1, 1.0, 1, d[0], 1),
    ]
    lines = [x for k in range(1, 13) for x in lines_of(k)] + [(1, None, 0, True)]
    got = sorted(r.line_id for r in inc.pending_lines(*tables(spark, listing, seen, lines)).collect())
    full = [1, 3, 4, 5, 7, 8, 10, 11]
    assert got == sorted([k * 100 + i for k in full for i in range(4)] + [202, 203, 903])


def test_empty_tables(spark):
    t = tables(spark, [("p1", 45, 1.0, DAY)], [("p1", 45, 1.0, 45, DAY, 1)], lines_of(1))
    assert inc.pending_lines(*t).count() == 0
    for k, n in ((0, 0), (1, 0), (2, 0), (3, 4), (4, 4)):
        assert inc.pending_lines(*[x.limit(0) if k == j else x for j, x in enumerate(t)]).count() == n


def source(spark, rows):
    return spark.createDataFrame(rows, "source_key string, source_version bigint, body string")


def test_target_is_the_state(spark):
    target = VersionedTarget(spark, f"{shared_dir(spark)}/target-a")
    first = source(spark, [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"), ("c", None, "n")])
    assert target.version() == 0 and target.read() is None
    assert target.publish(target.pending(first), 0) == 1
    second = source(spark, [("a", 2, "new"), ("b", 1, "z"), ("c", None, "n"), ("d", 1, "d")])
    pending = target.pending(second)
    assert sorted(tuple(r) for r in pending.collect()) == [("a", 2, "new"), ("d", 1, "d")]
    target.publish(pending, 1, retired=source(spark, [("b", 0, "")]))
    assert sorted(r.body for r in target.read().collect()) == ["d", "n", "new"]
    assert sorted(r.body for r in target.read(1).collect()) == ["n", "x", "y", "z"]
    assert sorted(tuple(r) for r in target.pending(second).collect()) == [("b", 1, "z")]


def test_failed_and_competing_runs(spark, monkeypatch):
    target = VersionedTarget(spark, f"{shared_dir(spark)}/target-b")
    rows = source(spark, [("a", 1, "x")])
    with monkeypatch.context() as m:
        m.setattr(VersionedTarget, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            target.publish(rows, 0)
    assert target.version() == 0 and target.pending(rows).count() == 1  # nothing visible, nothing lost
    target.publish(rows, 0)
    with pytest.raises(RuntimeError):  # another run began from version 0 too
        target.publish(source(spark, [("b", 1, "y")]), 0)
    assert [r.body for r in target.read().collect()] == ["x"]
    assert target.pending(rows).count() == 0


def test_ranges_own_the_lines_that_begin_in_them(spark, tmp_path):
    """Every split of a file, also inside lines and characters, gives the same lines and numbers."""
    text = "a\n\nbcd\r\nüüü\n" + "x" * 50 + "\nlast\ntail"
    (tmp_path / "f.log").write_bytes(text.encode())
    (tmp_path / "g.log").write_bytes(b"")
    (tmp_path / "h.log").write_bytes(b"\n\n")
    want, at = [], 0
    for n, x in enumerate(text.split("\n"), 1):
        size = len(x.encode())
        want.append((n, at, at + size + (x != "tail"), x, x != "tail"))
        at += size + 1
    files = ranges.listing(spark, [f"{tmp_path}/*.log"])
    plan = files.selectExpr("path", "size", "cast(0 as bigint) from_offset", "cast(0 as bigint) from_line")
    for size in (1, 2, 3, 5, 7, 20, 1000):
        got = ranges.read_ranges(plan, size).collect()
        assert sorted(tuple(r)[1:] for r in got if r.path.endswith("f.log")) == want
        assert sorted(tuple(r)[1:] for r in got if r.path.endswith("h.log")) == [(1, 0, 1, "", True), (2, 1, 2, "", True)] and not [r for r in got if r.path.endswith("g.log")]
    rest = plan.filter("path like '%f.log'").withColumn("from_offset", plan["from_offset"] + 3).withColumn("from_line", plan["from_line"] + 2)
    assert sorted(tuple(r)[1:] for r in ranges.read_ranges(rest, 4).collect()) == want[2:]


def test_runs_over_files(spark, tmp_path):
    target = VersionedTarget(spark, f"{shared_dir(spark)}/target-c")
    load = lambda **more: ingest.run(target, ranges.listing(spark, [f"{tmp_path}/*.log"]), range_bytes=4, **more)
    held = lambda: sorted((r.path[-5], r.line_no, r.raw) for r in target.read().collect())
    (tmp_path / "a.log").write_bytes(b"one\ntwo\nthr")
    (tmp_path / "b.log").write_bytes(b"unfinished")
    assert load() == 1 and held() == [("a", 1, "one"), ("a", 2, "two")]
    (tmp_path / "a.log").write_bytes(b"one\ntwo\nthree\n")
    with pytest.raises(InterruptedError):
        load(before_publish=lambda: (_ for _ in ()).throw(InterruptedError()))
    assert target.version() == 1 and len(held()) == 2
    assert load() == 2 and held() == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three")]
    base = target.version()
    (tmp_path / "b.log").write_bytes(b"unfinished\nno more\n")
    assert load() == 3 and len(held()) == 5
    with pytest.raises(RuntimeError):  # a run that began before the last publish
        target.publish(target.read(base), base)
    (tmp_path / "a.log").write_bytes(b"ONE\n")
    assert load() == 4 and held() == [("a", 1, "ONE"), ("b", 1, "unfinished"), ("b", 2, "no more")]
    (tmp_path / "b.log").write_bytes(b"x")
    assert load() == 5 and held() == [("a", 1, "ONE")]  # rewritten to an unfinished line: its rows are retired
    forgotten = spark.createDataFrame([(str(r.path),) for r in ranges.listing(spark, [f"{tmp_path}/a.log"]).collect()], "path string")
    (tmp_path / "a.log").write_bytes(b"ONE\nTWO\n")
    assert load(tombstones=forgotten) in (5, 6) and held() == [("a", 1, "ONE")]
    before = target.version()
    assert target.compact() == before + 1 and held() == [("a", 1, "ONE")] and len(target._manifest(before + 1)) == 1
    assert len(target.vacuum()) == 1 and held() == [("a", 1, "ONE")]  # the folder of the refused publish
    assert load() == before + 2 and held() == [("a", 1, "ONE"), ("a", 2, "TWO")]
