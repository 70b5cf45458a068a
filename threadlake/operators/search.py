"""Ranked full-text retrieval over turns and notes.

A term is a case-folded substring. Corpus statistics (rows, mean length, rows with each term) are
one partial aggregation; matching rows are scored by BM25 over overlapping occurrences, weighted
by age, and collapsed to one row per session. Filters apply after the statistics. The strategies
(all terms, all but the longest, any) nest, so one pass grades each row by the strictest it meets
and keeps the rows of the strictest grade that occurs.

Defined cases: null texts match nothing and have length 0; a query without usable terms gives no
rows; ties go by session, then by turn; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import age_days, like_ascii
from threadlake.storage import broadcast_if_bounded

# Ranking constants.
K1, B = 1.2, 0.75
HALF_LIFE_DAYS = 60.0
HIT_BONUS = 0.15
RARE_IDF = 1e-6
SHORTEST_TERM = 3

_TERM = re.compile(r"""(?P<phrase>"[^"]+")|(?P<single>(?<!\S)'[^']+')|(?P<word>[^\s"]+)""")


def terms(query: str) -> list[str]:
    """Terms of a query: a double-quoted phrase, a single-quoted one at the beginning of a word,
    or a run of other characters."""
    found = ((m.group().strip('"') if m.group("phrase") else m.group()[1:-1] if m.group("single") else m.group()) for m in _TERM.finditer(query))
    return [t.strip() for t in found if t.strip()]


def split_terms(query: str) -> tuple[list[str], list[str]]:
    """(long, short): terms that the ranking uses and those that only filter."""
    every = terms(query)
    return [t for t in every if len(t) >= SHORTEST_TERM], [t for t in every if len(t) < SHORTEST_TERM]


def _overlaps(term: str) -> bool:
    return any(term[k:] == term[:-k] for k in range(1, len(term)))


def occurrences(low: Column, term: str) -> Column:
    """Overlapping occurrences of a lower-case term in a lower-case text."""
    if _overlaps(term):
        return F.regexp_count(low, F.lit("(?=" + re.escape(term) + ")"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term)))) / len(term)).cast("int")


def _bm25(low: list[Column], length: Column, term: str, k: int) -> Column:
    f = sum((occurrences(x, term) for x in low[1:]), occurrences(low[0], term))
    n = F.col(f"__n{k}")
    idf = F.log((F.col("__rows") - n + 0.5) / (n + 0.5))
    idf = F.when(idf > 0, idf).otherwise(RARE_IDF)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.col("__mean")))


def graded(rows: DataFrame, columns: list[str], long: list[str], extra: Column | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """Rows that match at the strictest grade with any match, with ``grade`` (1 all terms, 2 all
    but the longest, 3 any) and ``bm`` (higher is better). extra filters rows, not statistics.
    corpus (one row: __rows, __mean) if rows are not all there are, but all that can match."""
    low_terms = [t.lower() for t in long]
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    length = sum((F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in columns[1:]), F.greatest(F.length(F.coalesce(F.col(columns[0]), F.lit(""))) - 2, F.lit(0)))
    has = []
    for t in low_terms:
        hit = low[0].contains(t)
        for x in low[1:]:
            hit = hit | x.contains(t)
        has.append(hit)
    stats = rows.agg(F.count("*").alias("__rows"), F.avg(length).alias("__mean"), *[F.count_if(h).alias(f"__n{k}") for k, h in enumerate(has)])
    if corpus is not None:
        stats = stats.drop("__rows", "__mean").join(F.broadcast(corpus))  # one row each
    # the longest, of several the last
    longest = max(range(len(long)), key=lambda k: (len(long[k]), k))
    every, any_ = has[0], has[0]
    for h in has[1:]:
        every, any_ = every & h, any_ | h
    rest = [h for k, h in enumerate(has) if k != longest]
    most = rest[0] if rest else F.lit(False)
    for h in rest[1:]:
        most = most & h
    grade = F.when(every, 1).when(most, 2).when(any_ & F.lit(len(long) > 1), 3)
    hits = rows.filter(any_)
    if extra is not None:
        hits = hits.filter(extra)
    hits = hits.withColumn("grade", grade).filter("grade is not null")
    best = hits.agg(F.min("grade").alias("__best"))
    hits = hits.join(F.broadcast(best), F.col("grade") <= F.col("__best")).join(F.broadcast(stats))
    parts = [_bm25(low, length, t, k) for k, t in enumerate(low_terms)]
    skipped = [F.when((F.col("__best") == 2) & F.lit(k == longest), 0.0).otherwise(p) for k, p in enumerate(parts)]
    bm = sum(skipped[1:], skipped[0])
    return hits.withColumn("bm", bm).withColumn("grade", F.col("__best")).drop("__best", "__rows", "__mean", *[f"__n{k}" for k in range(len(long))])


def matches(turns: DataFrame, query: str, extra: Column | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """Matching turns with grade and bm. Short terms filter; alone they match with bm 0."""
    long, short = split_terms(query)
    keep = extra
    for t in short:
        hit = like_ascii(F.col("text"), t)
        keep = hit if keep is None else keep & hit
    if long:
        return graded(turns, ["text"], long, keep, corpus)
    if not short:
        return turns.limit(0).withColumn("grade", F.lit(1)).withColumn("bm", F.lit(0.0))
    return turns.filter(keep).withColumn("grade", F.lit(1)).withColumn("bm", F.lit(0.0))


def weigh(hits: DataFrame, as_of: float) -> DataFrame:
    """hits with ``w``: relevance damped by the age of the turn."""
    base = F.when(F.col("bm") == 0, 1.0).otherwise(F.col("bm"))
    return hits.withColumn("w", F.round(base / (1 + age_days(F.col("ts"), as_of) / HALF_LIFE_DAYS), 9))


def rank_sessions(weighed: DataFrame, sessions: DataFrame, limit: int | None = 8) -> DataFrame:
    """(session_id, score, hits, best_turn, grade): one row per session that the catalogue holds."""
    per = weighed.groupBy("session_id").agg(F.max("w").alias("top"), F.count("*").alias("hits"), F.max_by("turn_id", F.struct(F.col("w"), -F.col("turn_id"))).alias("best_turn"), F.min("grade").alias("grade"))
    per = per.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    score = F.round(F.col("top") * (1 + HIT_BONUS * F.log1p("hits")), 6)
    ranked = per.select("session_id", score.alias("score"), "hits", "best_turn", "grade")
    return ranked if limit is None else ranked.orderBy(F.desc("score"), "session_id").limit(limit)


def top_turns(weighed: DataFrame, ranked: DataFrame, per_session: int = 3) -> DataFrame:
    """The best turns of the ranked sessions."""
    w = Window.partitionBy("session_id").orderBy(F.desc("w"), "turn_id")
    return weighed.join(broadcast_if_bounded(ranked.select("session_id", "score")), "session_id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_session)


def search_notes(notes: DataFrame, query: str, limit: int = 5, project: str | None = None) -> DataFrame:
    """Notes that match, those with more terms in name or description first, then by bm25, then
    the newest. A query of short terms alone finds none."""
    long, short = split_terms(query)
    if not long:
        return notes.limit(0)
    keep = None
    for t in short:
        hit = like_ascii(F.concat_ws("\x00", "body", "name", "description"), t)
        keep = hit if keep is None else keep & hit
    if project is not None:
        hit = like_ascii(F.col("project"), project)
        keep = hit if keep is None else keep & hit
    found = graded(notes, ["name", "description", "body"], long, keep)
    head = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))
    every = [t.lower() for t in terms(query)]
    in_head = sum((head.contains(t).cast("int") for t in every[1:]), head.contains(every[0]).cast("int"))
    return found.withColumn("in_head", in_head).withColumn("bm", F.round("bm", 6)).orderBy(F.desc("in_head"), F.desc("bm"), F.desc("mtime"), "note_id").limit(limit)


