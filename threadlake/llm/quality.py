"""Problem 8: text quality statistics of each document, outlier scores, and running prose.

Per document: words, mean word length, symbol ratio, share of lines that end in punctuation, share
of common words, and the share of its characters that belong to sentences (``prose``, a model
fitted on a bounded sample of labelled documents). Every statistic is ranked exactly within its
language: rows are sorted by range partitions on (language, statistic, value, row), so that a
language or a value that holds most rows is spread over tasks; ranks are local ranks plus the
offsets of the partitions before, and values that run over partition borders are joined up. From
the ranks come empirical-cumulative tail probabilities, within the language and among all documents,
and the outlier score is the weighted sum of minus their logarithms. The score alone decides: a
document whose score reaches the threshold is no prose. The tail of the share of sentences weighs
most, the others tip the balance where it says little. Three quarters of the labelled sample fit the
sentence model; the threshold comes from the quarter held back from it.

Defined cases. Null, empty and blank texts have no words: statistics 0, never prose. A null
language is the language "und"; languages are compared trimmed and in lower case. For a language
without a word list all lists count. Repeated rows are documents of their own. Ties share a rank.
Without labelled documents of both kinds only blank texts are reported. Very long texts are measured whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm import prose
from threadlake.storage import broadcast_if_bounded, materialize, spread

#: Labelled documents used to fit the model, at most, the longest of them that is used, and the
#: characters of all of them together.
MAX_LABELLED = 5_000
MAX_LABELLED_CHARS = 100_000
MAX_SAMPLE_CHARS = 10_000_000
#: One in so many labelled documents is held back from the sentence model.
HELD_BACK = 4
#: Stands for all languages together.
EVERY = "*"

STATS = ["n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share", "sentence_share"]
#: Which tail of a statistic speaks against prose.
TAILS = {"mean_word_length": "both", "symbol_ratio": "high", "line_end_share": "low", "common_share": "low", "sentence_share": "low"}

SCOPES = ["lang", "all"]
#: The tails a score is made of.
SCORED = [f"{s}_{scope}" for s in TAILS for scope in SCOPES]
WEIGHTS = {c: 1.0 if c == "sentence_share_all" else 0.0 if c == "sentence_share_lang" else 0.0025 for c in SCORED}
#: Share of labels more than the fewest that a threshold may get wrong.
TOLERATED = 0.003

_SCHEMA = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("blank", pa.bool_()), *[(s, pa.float64()) for s in STATS]])
_DDL = "item bigint, doc_id bigint, lang string, blank boolean, " + ", ".join(f"{s} double" for s in STATS)
_CLOSERS, _STOPS = "\"'»”)]", frozenset(".!?…")


def word_lists(common_words: DataFrame) -> DataFrame:
    """(lang, words): the common words of each language, and of all together under EVERY."""
    rows = common_words.filter("word is not null").select(F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), "word")
    return rows.unionByName(rows.withColumn("lang", F.lit(EVERY))).groupBy("lang").agg(F.array_sort(F.collect_set("word")).alias("words"))


def _measure(theta: np.ndarray | None):
    """Arrow batches of (item, doc_id, lang, text, its language's words, all words) to statistics.
    A list of words is turned into a set once for as long as it stays the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex  # noqa: PLC0415

        letters, numerals = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")
        sets: dict[str, frozenset] = {}
        known = None
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            rows = []
            for k, (lang, text) in enumerate(zip(b.column(2).to_pylist(), texts)):
                if lang not in sets:
                    sets[lang] = frozenset(b.column(4)[k].as_py() or ())
                words = letters.findall(text)
                n_letters = sum(map(len, words))
                n_solid = sum(map(len, text.split()))
                ends = [x.rstrip().rstrip(_CLOSERS)[-1:] for x in text.split("\n") if x and not x.isspace()]
                n = len(words)
                rows.append((
                    float(n),
                    n_letters / n if n else 0.0,
                    (n_solid - n_letters - sum(map(len, numerals.findall(text)))) / n_solid if n_solid else 0.0,
                    sum(map(_STOPS.__contains__, ends)) / len(ends) if ends else 0.0,
                    sum(map(sets[lang].__contains__, map(str.lower, words))) / n if n else 0.0,
                    not n_solid,
                ))
            columns = [pa.array(x) for x in zip(*rows)] if rows else [pa.array([], pa.float64())] * 5 + [pa.array([], pa.bool_())]
            sentences = np.zeros(len(texts))
            if theta is not None and texts:
                known = prose.Words(frozenset(b.column(5)[0].as_py() or ())) if known is None else known.fresh()
                sentences = np.round(prose.shares(texts, known, theta), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), columns[5], *columns[:5], pa.array(sentences, pa.float64())], schema=_SCHEMA)

    return run


def statistics(documents: DataFrame, lists: DataFrame, theta: np.ndarray | None = None) -> DataFrame:
    """One row of statistics per document row. lists: see ``word_lists``."""
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit("und"))
    every = broadcast_if_bounded(lists.filter(F.col("lang") == EVERY).select(F.col("words").alias("every")), 1)
    own = broadcast_if_bounded(lists.filter(F.col("lang") != EVERY), 1_000)
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), "text"))
    rows = rows.join(own, "lang", "left").join(every, F.lit(True), "left")
    return rows.select(F.monotonically_increasing_id().alias("item"), "doc_id", "lang", "text", F.coalesce("words", "every"), "every").mapInArrow(_measure(theta), _DDL)


def labelled_sample(documents: DataFrame, doc_labels: DataFrame, most: int = MAX_LABELLED) -> list:
    """(doc_id, prose share of its labels, text) of at most ``most`` labelled documents, in the
    order of a hash of the id, up to MAX_SAMPLE_CHARS characters."""
    votes = doc_labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.avg((F.lower(F.trim("label")) == "prose").cast("double")).alias("prose"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= MAX_LABELLED_CHARS)
    texts = texts.groupBy("doc_id", "prose").agg(F.max("text").alias("text")).withColumn("h", F.xxhash64("doc_id"))
    upto = F.sum(F.length("text")).over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of the sample only
    return texts.withColumn("upto", upto).filter(F.col("upto") <= MAX_SAMPLE_CHARS).orderBy("h", "doc_id").select("doc_id", "prose", "text").collect()


def fit_prose(labelled: list, common: set[str]) -> np.ndarray:
    coded = prose.encode([r.text for r in labelled], prose.Words(frozenset(common)))
    return prose.fit(coded, np.array([float(r.prose) for r in labelled]))


def exact_ranks(rows: DataFrame, groups: list[str], value: str, row: str) -> DataFrame:
    """rows with n_below and n_upto (how many values of the group are less, and less or equal) and
    n_group. Sorted by range partitions; no group and no value needs to fit in a task."""
    keys = [*groups, value, row]
    ranged = rows.repartitionByRange(*keys).withColumn("__pid", F.spark_partition_id())
    ranged, _ = materialize(ranged, "ranges")
    local = Window.partitionBy(*groups, "__pid").orderBy(value)
    upto = F.count(F.lit(1)).over(local.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("__lt", F.rank().over(local) - 1).withColumn("__le", upto)
    ends = ranged.groupBy(*groups, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    order = Window.partitionBy(*groups).orderBy("__pid")
    ends = ends.withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.withColumn("n_group", F.sum("__n").over(Window.partitionBy(*groups)))
    ends, _ = materialize(ends, "offsets")
    # values at the ends of a partition may go on in its neighbours
    border = ends.select(*groups, F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("__v"), "__pid")
    border = border.withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*groups, "__v"))).filter("__m > 1").select(*groups, "__v", "__pid")
    tied = ranged.join(broadcast_if_bounded(border.withColumnRenamed("__v", value)), [*groups, value, "__pid"], "left_semi")
    tied = tied.groupBy(*groups, value, "__pid").agg(F.count(F.lit(1)).alias("__c"))
    over = Window.partitionBy(*groups, value).orderBy("__pid")
    tied = tied.withColumn("__c_before", F.coalesce(F.sum("__c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tied = tied.withColumn("__c_after", F.sum("__c").over(Window.partitionBy(*groups, value)) - F.col("__c_before") - F.col("__c"))
    out = placed.join(broadcast_if_bounded(ends.select(*groups, "__pid", "__before", "n_group")), [*groups, "__pid"])
    out = out.join(broadcast_if_bounded(tied.drop("__c")), [*groups, value, "__pid"], "left")
    return out.select(
        *rows.columns,
        (F.col("__before") + F.col("__lt") - F.coalesce("__c_before", F.lit(0))).alias("n_below"),
        (F.col("__before") + F.col("__le") + F.coalesce("__c_after", F.lit(0))).alias("n_upto"),
        "n_group",
    )


def ranks(stats: DataFrame, names: list[str]) -> DataFrame:
    """Long form: (item, doc_id, lang, stat, value, n_below, n_upto, n_group)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in names])
    long = stats.select("item", "doc_id", "lang", F.explode(pairs).alias("p")).select("item", "doc_id", "lang", "p.*")
    return exact_ranks(long, ["lang", "stat"], "value", "item")


def tails(stats: DataFrame) -> DataFrame:
    """(item, doc_id, blank, SCORED...): of each statistic minus the logarithm of the tail
    probability, that is the share of documents at least as extreme, within the document's language
    and among all."""
    low, high = F.col("n_upto") / F.col("n_group"), (F.col("n_group") - F.col("n_below")) / F.col("n_group")
    tail = F.lit(None).cast("double")
    for s, which in TAILS.items():
        t = {"low": low, "high": high, "both": F.least(F.lit(1.0), 2 * F.least(low, high))}[which]
        tail = F.when(F.col("stat") == s, t).otherwise(tail)
    both = stats.withColumn("lang", F.explode(F.array("lang", F.lit(EVERY))))
    ranked = ranks(both, list(TAILS)).select("item", F.when(F.col("lang") == EVERY, F.concat("stat", F.lit("_all"))).otherwise(F.concat("stat", F.lit("_lang"))).alias("tail_of"), F.round(-F.log(tail), 9).alias("t"))
    wide = ranked.groupBy("item").agg(*[F.max(F.when(F.col("tail_of") == c, F.col("t"))).alias(c) for c in SCORED])
    return stats.select("item", "doc_id", "blank").join(wide, "item")


def fit_threshold(score: np.ndarray, other: np.ndarray) -> float:
    """The score from which on a document is no prose, from labelled ones (other: share of raters
    that say it is none). Of the cuts with the fewest labels wrong, or TOLERATED of all labels more,
    as raters err, the one in the widest gap between scores."""
    order = np.argsort(score, kind="stable")
    s, right = score[order], other[order]
    wrong = np.cumsum(right)[:-1] + (1 - right).sum() - np.cumsum(1 - right)[:-1]
    good = np.flatnonzero(wrong <= wrong.min() + TOLERATED * len(s))
    k = good[int(np.argmax(s[good + 1] - s[good]))]
    return float((s[k] + s[k + 1]) / 2)


def outlier_scores(table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(item, doc_id, blank, score): the weighted sum of the tails."""
    score: Column = sum((F.col(c) * float(w) for c, w in (weights or WEIGHTS).items()), F.lit(0.0))
    return table.select("item", "doc_id", "blank", F.round(score, 9).alias("score"))


def held_back(labelled: list) -> tuple[list, list]:
    """(held, taught): of the labelled documents of each kind one in HELD_BACK, and the others; the
    only document of a kind serves for both."""
    held, taught = [], []
    for prose_like in (True, False):
        own = [r for r in labelled if (r.prose >= 0.5) == prose_like]
        held += own[::HELD_BACK]
        taught += [r for k, r in enumerate(own) if k % HELD_BACK or len(own) == 1]
    return held, taught


def scored(documents: DataFrame, doc_labels: DataFrame, common_words: DataFrame) -> tuple[DataFrame, float | None, list]:
    """(item, doc_id, blank, score) of every document, the threshold (None without labels of both
    kinds), and the labelled scores that it comes from."""
    lists, _ = materialize(word_lists(common_words), "words")
    labelled = labelled_sample(documents, doc_labels)
    held, taught = held_back(labelled)
    if len({r.prose >= 0.5 for r in labelled}) < 2:
        rows = statistics(documents, lists)
        return rows.select("item", "doc_id", "blank", F.lit(0.0).alias("score")), None, []
    common = lists.filter(F.col("lang") == EVERY).select(F.explode("words")).collect()
    theta = fit_prose(taught, {r[0] for r in common})
    stats, _ = materialize(statistics(documents, lists, theta), "stats")
    scores, _ = materialize(outlier_scores(tails(stats)), "scores")
    votes = documents.sparkSession.createDataFrame([(r.doc_id, r.prose) for r in held], "doc_id bigint, prose double")
    known = scores.join(F.broadcast(votes), "doc_id").groupBy("doc_id", "prose").agg(F.max("score").alias("score")).orderBy("doc_id").collect()
    return scores, fit_threshold(np.array([r.score for r in known]), np.array([1 - r.prose for r in known])), known


def not_prose(documents: DataFrame, doc_labels: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, score) of the documents that are not running prose: those whose outlier score
    reaches the threshold, and blank ones."""
    scores, threshold, _ = scored(documents, doc_labels, common_words)
    out = F.col("blank") if threshold is None else F.col("blank") | (F.col("score") >= threshold)
    return scores.filter(out).select("doc_id", "score")


def agreement(documents: DataFrame, doc_labels: DataFrame, common_words: DataFrame) -> DataFrame:
    """(labels, right): documents that two raters or more agree on, and for how many the result
    agrees with them."""
    votes = doc_labels.filter("label is not null").groupBy("doc_id").agg(F.avg((F.lower(F.trim("label")) == "prose").cast("double")).alias("prose"), F.count("*").alias("n")).filter("n > 1 and prose in (0, 1)")
    found = not_prose(documents, doc_labels, common_words).select("doc_id").distinct().withColumn("found", F.lit(True))
    both = votes.join(found, "doc_id", "left").withColumn("right", F.coalesce("found", F.lit(False)) == (F.col("prose") == 0))
    return both.agg(F.count("*").alias("labels"), F.count_if("right").alias("right"))
