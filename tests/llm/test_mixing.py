import random

from pyspark.sql import functions as F

from threadlake.llm import mixing

DOCS = "doc_id bigint, text string, source string, mix string, rate string, copies string"
TARGETS = "mix_name string, source string, weight double, max_repeats bigint, tokens string"


def docs(spark, n=1200, seed=1):
    rng = random.Random(seed)
    spelled = {"a_b": ["a_b", "A_B", " a-b", "a b "], "c": ["c", "C "], "d": ["d"]}
    rows = []
    for k in range(n):
        s = rng.choices(["a_b", "c", "d"], [10, 5, 1])[0]
        word = {"a_b": "alpha beta", "c": "gamma delta", "d": "omega psi"}[s]
        rows.append((k, " ".join(rng.choice([word, "same"]) for _ in range(rng.randrange(1, 30))), rng.choice(spelled[s]), "", "", ""))
    rows += [(90_000, None, "c", "", "", ""), (90_001, "", "c", "", "", ""), (90_002, "x", "nowhere", "", "", "")]
    return rows


def report(df, targets):
    return {(r.mix_name, r.source): r for r in mixing.shares(df, targets).collect()}


def test_shares_and_caps(spark):
    table = spark.createDataFrame(docs(spark), DOCS)
    targets = spark.createDataFrame([("m", "A-B", 2.0, 1, ""), ("m", "c", 1.0, 2, ""), ("m", "d", 1.0, 4, ""), ("m", "gone", 1.0, 9, ""), ("m", "e", 0.0, 1, ""), ("w", "d", 3.0, 2, ""), ("w", "c", 1.0, None, ""), ("z", None, 1.0, 1, "")], TARGETS)
    taken = mixing.select(table, targets)
    got = report(taken, targets)
    for s, share in (("a_b", 0.5), ("c", 0.25), ("d", 0.25)):
        assert abs(got["m", s].actual_share - share) < 0.01
    assert got["m", "d"].most_copies == 4 and got["m", "a_b"].most_copies <= 1 and got["m", "gone"].tokens == 0
    assert got["w", "d"].actual_share == 1.0 and got["w", "d"].most_copies == 2
    rows = taken.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows) and not {90_000, 90_001} & {r.doc_id for r in rows}
    # the size is the largest that the caps allow: the small source is used up
    assert got["m", "d"].documents == sum(r[2] == "d" for r in docs(spark))


def test_given_size(spark):
    targets = spark.createDataFrame([("m", "a_b", 1.0, 3, ""), ("m", "c", 1.0, 3, "")], TARGETS)
    got = report(mixing.select(spark.createDataFrame(docs(spark), DOCS), targets, total_tokens=5000.0), targets)
    assert abs(sum(r.tokens for r in got.values()) - 5000) < 150 and abs(got["m", "c"].actual_share - 0.5) < 0.02


def test_unknown_sources_are_predicted(spark):
    rows = docs(spark, 2000)
    hidden = [(k, t, None if k % 4 == 0 else s, *rest) for k, t, s, *rest in rows]
    targets = spark.createDataFrame([("m", "a_b", 1.0, 1, ""), ("m", "c", 1.0, 1, ""), ("m", "d", 1e-9, 1, "")], TARGETS)
    known, soft, names = mixing.soft_members(spark.createDataFrame(hidden, DOCS), mixing.merged_targets(targets))
    assert names == ["OTHER", "a_b", "c", "d"] and known.filter("source is null").count() == 0
    truth = {r[0]: r[2].strip().lower().replace("-", "_").replace(" ", "_") for r in rows if r[1] and len(r[1].split()) > 8}
    guesses = soft.collect()
    assert all(sum(r.units) == mixing.POST for r in guesses)
    guessed = {r.doc_id: names[max(zip(r.units, r.classes))[1]] for r in guesses}
    right = [guessed[k] == truth[k] for k in guessed if k in truth and truth[k] in names]
    assert len(right) > 100 and sum(right) / len(right) > 0.9
    targets = targets.filter("source <> 'd'")
    table = spark.createDataFrame(hidden, DOCS)
    got = report(mixing.select(table, targets), targets)
    assert abs(got["m", "c"].actual_share - 0.5) < 0.02
    assert mixing.rated(table, targets).join(soft, "doc_id").count() > 100  # documents without a source are taken


def test_fit_meets_its_targets_under_caps(spark):
    """Expected tokens of every class, soft documents included, equal the goals."""
    import numpy as np

    rng = random.Random(4)
    post = [[k, 3 - k] for k in (0, 1, 3) for _ in range(40)]
    soft = spark.createDataFrame([(rng.randrange(1, 50), [0, 1], [p[0] * mixing.POST // 3, mixing.POST - p[0] * mixing.POST // 3]) for p in post], "n_tokens bigint, classes array<int>, units array<int>")
    goal = spark.createDataFrame([("m", "x", 1, 500, 400.0), ("m", "y", 1, 900, 300.0)], "mix_name string, source string, cap bigint, mass bigint, goal double")
    mixes, x, caps, wanted, off = mixing.fit_rates(soft, goal.collect(), ["x", "y"])
    total = np.array([500.0, 900.0]) * x[0]
    for r in soft.collect():
        p = np.array(r.units) / mixing.POST
        total += p * r.n_tokens * min(max(p @ x[0], 0), p @ caps[0])
    assert off <= 1e-5 and np.allclose(total, [400, 300], rtol=1e-3)


def test_same_selection_however_the_table_is_split(spark):
    rows = docs(spark, 900) + docs(spark, 30) + [(1, "alpha alpha", "c", "", "", "")] * 50
    rows = [(k, t, None if k % 5 == 0 else s, *rest) for k, t, s, *rest in rows]
    targets = spark.createDataFrame([("m", "a_b", 2.0, 1, ""), ("m", "c", 1.0, 2, ""), ("m", "d", 1.0, 4, "")], TARGETS)
    table = spark.createDataFrame(rows, DOCS)
    one, many = (sorted(map(tuple, mixing.select(t, targets).collect()), key=str) for t in (table.coalesce(1), table.orderBy(F.rand(3)).repartition(7)))
    assert one and one == many


def test_long_documents_do_not_end_a_source(spark):
    """A document that does not fit is skipped, and the search goes on in further cells."""
    rng = random.Random(5)
    rows = [("m", s, k, k, 0, rng.choice([1, 5, 30, 60, 4000]), 0.37, 2) for s in ("a", "b") for k in range(600)]
    table = spark.createDataFrame(rows, "mix_name string, source string, doc_id bigint, text_hash bigint, copy_no bigint, n_tokens bigint, rate double, cap bigint")
    for size in (20_000, 25):
        mixing.CELL_ROWS, held = size, mixing.CELL_ROWS
        try:
            got = mixing.whole_copies(table).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("c"), F.count("*").alias("n")).collect()
        finally:
            mixing.CELL_ROWS = held
        for r in got:
            want = sum(0.37 * x[5] for x in rows if x[1] == r.source)
            assert 0 <= want - r.t < want * mixing.OPEN_SHARE + 5 and r.c == 1


def test_choose():
    import numpy as np

    for sizes, left in (([5, 5, 100, 5], 104), ([3, 3, 3, 3, 50], 53), ([7], 6), ([], 9), ([2] * 40 + [77], 80)):
        more, over = mixing.choose(np.array(sizes, np.int64), left, 0)
        assert over == left - sum(s for s, m in zip(sizes, more) if m) >= 0
        best = {0}
        for s in sizes:
            best |= {b + s for b in best if b + s <= left}
        assert over <= left - max(best) + 1


def test_empty(spark):
    table, targets = spark.createDataFrame(docs(spark, 50), DOCS), spark.createDataFrame([("m", "c", 1.0, 1, "")], TARGETS)
    assert mixing.select(table.limit(0), targets).count() == 0
    assert mixing.select(table, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.select(table.limit(0), targets), targets).count() == 1


def test_sources_that_no_mix_names_are_not_taken(spark):
    """A long tail of sources, each below one document in a thousand, is known and never taken."""
    rows = docs(spark, 1500) + [(100_000 + k, "alpha beta same gamma delta", f"tail_{k}", "", "", "") for k in range(1200)]
    targets = spark.createDataFrame([("m", "a_b", 1.0, 1, ""), ("m", "c", 1.0, 1, "")], TARGETS)
    taken = mixing.select(spark.createDataFrame(rows, DOCS), targets).collect()
    truth = {r[0]: r[2].strip().lower().replace("-", "_").replace(" ", "_") for r in rows}
    assert taken and all(r.source == truth[r.doc_id] for r in taken)


def test_rare_and_oddly_named_sources_stay_what_they_are(spark):
    rows = [(k, "alpha beta", "c", "", "", "") for k in range(1500)] + [(5000, "alpha beta", "cc", "", "", ""), (5001, "alpha", "c_", "", "", "")]
    targets = spark.createDataFrame([("m", "c", 1.0, 1, ""), ("m", "cc", 1.0, 700, "")], TARGETS)
    taken = {(r.doc_id, r.source, r.copies) for r in mixing.select(spark.createDataFrame(rows, DOCS), targets).collect()}
    assert {t for t in taken if t[0] >= 5000} == {(5000, "cc", 700)}
