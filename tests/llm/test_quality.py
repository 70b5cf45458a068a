import random

import numpy as np

from threadlake.llm import prose, quality

DOCS = "doc_id bigint, text string, lang string, prose double, item string, n_words string"
WORDS = "lang string, word string"


def test_exact_ranks(spark):
    """Ties across partitions, one value and one group holding most rows."""
    rng = random.Random(1)
    rows = [(k, "en" if k % 10 else rng.choice(["de", "fr"]), float(rng.choice([0, 0, 0, 1, rng.randrange(50), rng.random()]))) for k in range(4000)]
    df = spark.createDataFrame(rows, "item bigint, lang string, value double")
    got = quality.exact_ranks(df.repartition(9), ["lang"], "value", "item").collect()
    assert len(got) == len(rows)
    by = {}
    for _, g, v in rows:
        by.setdefault(g, []).append(v)
    for r in got:
        values = by[r.lang]
        assert (r.n_below, r.n_upto, r.n_group) == (sum(v < r.value for v in values), sum(v <= r.value for v in values), len(values))


def test_statistics(spark):
    rows = [(1, "The cat, sat.\nNo end\n\n", "EN ", 0.0, "", ""), (2, None, None, 0.0, "", ""), (3, " \n", "en", 0.0, "", ""), (4, "De kat", "nl", 0.0, "", ""), (5, "a" * 1_000_000, "en", 0.0, "", "")]
    lists = quality.word_lists(spark.createDataFrame([("en", "the"), ("EN ", "no"), ("de", "de"), ("de", None)], WORDS))
    got = {r.doc_id: r for r in quality.statistics(spark.createDataFrame(rows, DOCS), lists).collect()}
    assert (got[1].n_words, got[1].mean_word_length, got[1].line_end_share, got[1].common_share, got[1].lang) == (5, 2.8, 0.5, 0.4, "en")
    assert abs(got[1].symbol_ratio - 2 / 16) < 1e-12
    assert (got[2].n_words, got[2].lang, got[3].symbol_ratio, got[4].common_share, got[5].mean_word_length) == (0, "und", 0.0, 0.5, 1e6)
    assert quality.statistics(spark.createDataFrame([], DOCS), lists).count() == 0


SENTENCE = ["The {a} was {b} because nobody had {c} the {d} since Monday.", "I would rather {c} the {a} than {c} the {d} now.", "After that, the {a} {b} the {d} and the {a}.", "What happens when the {a} is {b} and the {d} is not?"]
NOISE = ["{a} {d}", "- {a} with {b} {d}", "{a} = {n}", "{a}\t{n}\t{n}", "12:{n} INFO {a}.{d} done", "return {a}[{n}]"]


def text(rng, kinds, n):
    pick = lambda: {"a": rng.choice(["queue", "ledger", "parser", "window"]), "b": rng.choice(["broken", "closed", "stale", "merged"]), "c": rng.choice(["move", "checked", "trim"]), "d": rng.choice(["index", "note", "banner"]), "n": rng.randrange(99)}
    return [rng.choice(kinds).format(**pick()) for _ in range(n)]


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    for k in range(n):
        good, bad = (6, 0) if k % 3 else (0, 8)
        if k % 5 == 0:
            good, bad = good + 1, bad + 1
        join = rng.choice(["\n", " "]) if bad == 0 else "\n"
        rows.append((k, join.join(text(rng, SENTENCE, good)) + "\n" + "\n".join(text(rng, NOISE, bad)), "en", 0.0, "", ""))
    return rows, {k for k in range(n) if k % 3 == 0}


def test_not_prose_held_out(spark):
    rows, other = corpus(1, 600)
    rows += [(900, "", "en", 0.0, "", ""), (901, None, None, 0.0, "", ""), (902, "and then the\n" * 200, "en", 0.0, "", "")]
    rng = random.Random(9)
    labels = [(k, "list" if (k in other) != (rng.random() < 0.04) else "prose") for k in range(0, 300)]
    words = spark.createDataFrame([("en", w) for w in "the was because had since i than now after that and what when is not".split()], WORDS)
    got = quality.not_prose(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, label string"), words)
    found = {r.doc_id for r in got.collect()}
    assert {900, 901, 902} <= found
    held = range(300, 600)
    assert sum((k in found) == (k in other) for k in held) / 300 > 0.97


def test_without_labels_or_rows(spark):
    docs, labels, words = spark.createDataFrame(corpus(2, 5)[0], DOCS), spark.createDataFrame([], "doc_id bigint, label string"), spark.createDataFrame([("en", "the")], WORDS)
    assert quality.not_prose(docs, labels, words).count() == 0
    assert quality.not_prose(docs.limit(0), labels, words).count() == 0
    blank = spark.createDataFrame([(1, " ", "en", 0.0, "", "")], DOCS)
    assert quality.not_prose(blank, labels, words.limit(0)).count() == 1


def test_chunks_cover_the_text():
    long = "word " * 5000 + "\n> one. Two! three\n\n\t\n" + "x" * 50_000
    solid = sum(len(w) for p, _, _ in prose.chunks(long) for w in p.split())
    assert solid == sum(map(len, long.split())) - 1  # the mark at the line's beginning
    assert prose.shares(["", " \n"], prose.Words(frozenset()), np.zeros(prose.DIMENSIONS + 1)).tolist() == [0.0, 0.0]


def test_a_batch_is_encoded_like_its_texts():
    """Neither the other texts of a batch nor what was seen before changes a share."""
    rng = np.random.default_rng(1)
    texts = [t for _, t, *_ in corpus(5, 60)[0]] + ["", "a", "¿ü? 12:30\n\nx y. z", "same\n" * 7]
    theta = rng.normal(size=prose.DIMENSIONS + 1)
    words = prose.Words(frozenset(["the", "was"]))
    whole = prose.shares(texts, words, theta)
    assert np.allclose(whole, [prose.shares([t], prose.Words(frozenset(["the", "was"])), theta)[0] for t in texts])
    held, prose.BATCH_CHARS = prose.BATCH_CHARS, 50
    try:
        assert np.allclose(whole, prose.shares(texts, words, theta))
    finally:
        prose.BATCH_CHARS = held
    assert whole[-1] == 0.0  # repetition is no sentence


def test_line_ends_are_looked_for_in_the_whole_line(spark):
    rows = [(1, "A line." + " " * 80 + "\nopen" + "\u2028" * 3, "en", 0.0, "", ""), (2, 'He said "no."' + ")" * 100 + "\t", "en", 0.0, "", "")]
    lists = quality.word_lists(spark.createDataFrame([], WORDS))
    assert {r.doc_id: r.line_end_share for r in quality.statistics(spark.createDataFrame(rows, DOCS), lists).collect()} == {1: 0.5, 2: 1.0}


def test_labels_are_held_back_by_kind():
    from types import SimpleNamespace as N

    rows = [N(doc_id=k, prose=float(k % 3 > 0)) for k in range(24)]
    held, taught = quality.held_back(rows)
    assert len(held) == 6 and len(taught) == 18 and not {r.doc_id for r in held} & {r.doc_id for r in taught}
    assert [r.prose for r in held] == [1.0] * 4 + [0.0] * 2
    held, taught = quality.held_back(rows[:3])
    assert {r.doc_id for r in held} == {0, 1} and {r.doc_id for r in taught} == {0, 2} and quality.held_back([]) == ([], [])


def test_threshold():
    """It lies in the gap between the kinds, despite wrong labels far from it and one close by."""
    rng = np.random.default_rng(2)
    score = np.concatenate([rng.uniform(0, 1.3, 800), rng.uniform(1.6, 9, 300)])
    other = (score > 1.5).astype(float)
    wrong = rng.random(1100) < 0.04
    noisy = np.where(wrong, 1 - other, other)
    noisy[np.argmin(np.abs(score - 1.3))] = 1.0
    assert 1.3 <= quality.fit_threshold(score, noisy) <= 1.61
    assert quality.fit_threshold(np.array([0.0, 2.0]), np.array([0.0, 1.0])) == 1.0


def test_scores_are_weighted_sums_of_tails(spark):
    rows = [(k, t, "de" if k % 3 else lang, *more) for k, t, lang, *more in corpus(3, 40)[0]]
    lists = quality.word_lists(spark.createDataFrame([("en", "the")], WORDS))
    stats = quality.statistics(spark.createDataFrame(rows, DOCS), lists).cache()
    weights = {c: k + 1.0 for k, c in enumerate(quality.SCORED)}
    scores = {r.doc_id: r.score for r in quality.outlier_scores(quality.tails(stats), weights).collect()}
    table, total = stats.collect(), {}
    for c in quality.SCORED:
        s, scope = c.rsplit("_", 1)
        for r in table:
            values = [x[s] for x in table if scope == "all" or x.lang == r.lang]
            low, high = sum(v <= r[s] for v in values) / len(values), sum(v >= r[s] for v in values) / len(values)
            tail = {"low": low, "high": high, "both": min(1, 2 * min(low, high))}[quality.TAILS[s]]
            total[r.doc_id] = total.get(r.doc_id, 0) - weights[c] * np.log(tail)
    assert all(abs(scores[k] - v) < 1e-6 for k, v in total.items()) and len(scores) == 40
