from collections import Counter

from pyspark.sql import functions as F

from threadlake.operators import dense

ROWS = "k string, v bigint, n int, keys string, block int"


def plain(rows):
    out = {}
    for k in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == k and r[1] is not None]
        out[k] = (sum(r[0] == k for r in rows), sum(v) if v else None, min(v, default=None), max(v, default=None))
    return out


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(dense, "FLUSH_CELLS", 50)  # many flushes
    monkeypatch.setattr(dense, "FAN", 2)
    rows = [(("hot" if k % 3 == 0 else f"k{k % 701}") if k % 50 else None, None if k % 7 == 0 else k * 10**12 - 5, k, "x", k) for k in range(5000)] + [("", 1, 1, "x", 1), (" ", None, 1, "x", 1)]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    got = dense.dense_aggregate(df, "k", total=("sum", "v"), least=("min", "v"), most=("max", "v"))
    assert {r.key_value: (r.n, r.total, r.least, r.most) for r in got.collect()} == plain(rows)


def test_no_row_is_shuffled(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("k"))
    assert [tuple(r) for r in dense.dense_aggregate(df, "k").collect()] == [("hot", 100_000)]


def test_heavy_keys(spark):
    rows = [("a",)] * 5 + [("b",)] * 4 + [(f"x{k}",) for k in range(91)] + [(None,)] * 500 + [(" \u00a0\t",)] * 500 + [("",)] * 500
    got = dense.heavy_keys(spark.createDataFrame(rows, "k string"), "k", "t.k").collect()
    assert [tuple(r) for r in got] == [("t.k", "a")]


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert dense.dense_aggregate(df, "k", s=("sum", "v")).count() == 0
    assert dense.heavy_keys(df, "k", "f").count() == 0


def test_keys_as_stored(spark):
    rows = [("A",), ("a",), ("a ",), ("é",), ("e\u0301",), ("x" * 100_000,), ("x" * 100_000,)]
    got = dense.dense_aggregate(spark.createDataFrame(rows, "k string"), "k").collect()
    assert {r.key_value: r.n for r in got} == Counter(r[0] for r in rows)
