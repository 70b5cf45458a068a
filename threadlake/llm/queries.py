"""Queries of the problems on training data: 3, 6, 7 and 8, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import conversations, mixing, packing, quality
from threadlake.plans.log_sql import STRICT_JSON
from threadlake.sources.tables import table
from threadlake.sources.transcripts import records
from threadlake.storage import materialize, spread


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "turns")).select("session_id", "pos", "turn_id")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "turns"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    lines = spread(table(spark, d, "transcript_lines").select("line_id", "has_newline", "raw"))
    return records(lines, ["line_id"], '"uuid"').select("line_id", "uuid", F.col("parent_uuid").alias("parent"))


def p3_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads of the records by the pointers they carry."""
    return conversations.threads(_linked(spark, d))


def p3_planted(spark: SparkSession, d: str) -> DataFrame:
    """The same with planted faults: every parent of a record whose line is divisible by 97 names a
    record that does not exist, and every root whose line is divisible by 5 names its own child as
    its parent, if it has one."""
    rows = _linked(spark, d)
    child = rows.filter("parent is not null").groupBy(F.col("parent").alias("uuid")).agg(F.min("uuid").alias("child"))
    rows = rows.join(child, "uuid", "left")
    lost = F.col("parent").isNotNull() & (F.col("line_id") % 97 == 0)
    looped = F.col("parent").isNull() & (F.col("line_id") % 5 == 0)
    return conversations.threads(rows.withColumn("parent", F.when(lost, F.lit("no such record")).when(looped, F.col("child")).otherwise(F.col("parent"))))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_selection(spark, d), table(spark, d, "mix_targets"))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of a sound packing, for comparison with SQL."""
    documents = table(spark, d, "documents")
    return packing.invariants(p6_pack(spark, d), documents)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The share due and whether it is reached within half a point and under the caps."""
    return mixing.invariants(p7_selection(spark, d), table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_soft_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares, by true sources, of a selection for which one source in five is hidden."""
    hidden, targets = mixing.hide_sources(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.true_shares(mixing.select(hidden, targets), hidden, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "common_words")).select("doc_id")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), quality.word_lists(table(spark, d, "common_words")))


def p8_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether the result meets 17 in 20 of the labels that raters agree on."""
    got = quality.agreement(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "common_words"))
    return got.select("labels", (F.col("right") * 20 >= F.col("labels") * 17).alias("met"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document, without the fitted one."""
    return _stats(spark, d).select("doc_id", "lang", F.col("n_words").cast("bigint").alias("n_words"), *[F.round(s, 9).alias(s) for s in _PLAIN[1:]])


def p8_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Exact ranks of every statistic within its language."""
    stats = materialize(_stats(spark, d), "stats")[0]
    return quality.ranks(stats, _PLAIN).select("doc_id", "lang", "stat", "n_below", "n_upto", "n_group")


_PLAIN = ["n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share"]

QUERIES = {f.__name__: f for f in (p3_found, p3_conversations, p3_threads, p3_planted, p6_pack, p6_fill, p6_invariants, p7_selection, p7_shares, p7_invariants, p7_soft_shares, p8_found, p8_agreement, p8_stats, p8_ranks)}

_INSTANT = r"'(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)'"
_BLANK = r"[\s\p{Z}\x{85}\x1c-\x1f]"

_KEPT = rf"""
    WITH raw AS (SELECT *, row_number() OVER (PARTITION BY session_id, file_id, seq ORDER BY turn_id) AS rn FROM turns WHERE session_id IS NOT NULL),
         m AS (SELECT session_id, file_id, seq, turn_id, text, NOT coalesce(is_sidechain, false) AS main,
                      CASE lower(regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user'
                           WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system' END AS role,
                      CASE WHEN regexp_full_match(ts, {_INSTANT}) THEN try_cast(ts AS TIMESTAMPTZ) END AS moment
               FROM raw WHERE rn = 1),
         f AS (SELECT session_id, file_id, min(moment) AS moment, count(*) = max(seq) AND min(seq) = 1 AND count(seq) = count(*) AS whole FROM m GROUP BY session_id, file_id),
         fo AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY moment NULLS LAST, file_id NULLS FIRST) AS fn FROM f),
         o AS (SELECT m.*, row_number() OVER (PARTITION BY m.session_id ORDER BY fn, seq) AS pos FROM m JOIN fo ON m.session_id = fo.session_id AND m.file_id IS NOT DISTINCT FROM fo.file_id WHERE main),
         t AS (SELECT session_id, pos, role, lag(role) OVER w AS prev, row_number() OVER w AS k, lead(role) OVER w IS NULL AS fin FROM o WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
         good AS (SELECT session_id FROM o GROUP BY session_id
                  HAVING bool_and(role IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(text, '^{_BLANK}*$'))
                  INTERSECT SELECT session_id FROM f GROUP BY session_id HAVING bool_and(coalesce(whole, false))
                  INTERSECT SELECT session_id FROM t GROUP BY session_id
                  HAVING bool_or(k = 1 AND role = 'user') AND NOT bool_or(coalesce(role = 'user' AND prev = 'user', false)) AND bool_or(fin AND role = 'assistant'))"""

_STATS = r"""
    WITH lists AS (SELECT lower(trim(lang)) AS lang, word FROM common_words WHERE word IS NOT NULL),
         known AS (SELECT lang, list(DISTINCT word) AS words FROM lists GROUP BY lang),
         d AS (SELECT doc_id, coalesce(lower(trim(lang)), 'und') AS lang, coalesce(text, '') AS text FROM documents),
         w AS (SELECT d.*, regexp_extract_all(text, '\p{L}+') AS words, regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]') AS solid,
                      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')) AS lines,
                      coalesce(known.words, (SELECT list(DISTINCT word) FROM lists)) AS common
               FROM d LEFT JOIN known USING (lang)),
         s AS (SELECT doc_id, lang, len(words) AS n_words,
                      CASE WHEN len(words) = 0 THEN 0.0 ELSE CAST(list_sum(list_transform(words, lambda x: length(x))) AS DOUBLE) / len(words) END AS mean_word_length,
                      CASE WHEN len(solid) = 0 THEN 0.0 ELSE CAST(len(list_filter(solid, lambda x: NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS DOUBLE) / len(solid) END AS symbol_ratio,
                      CASE WHEN len(lines) = 0 THEN 0.0 ELSE CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…]["''»”)\]]*\s*$'))) AS DOUBLE) / len(lines) END AS line_end_share,
                      CASE WHEN len(words) = 0 THEN 0.0 ELSE CAST(len(list_filter(words, lambda x: list_contains(common, lower(x)))) AS DOUBLE) / len(words) END AS common_share
               FROM w)"""


def _threads(parent: str) -> str:
    """Threads by walking down from roots and orphans; what is never reached is on or below a cycle."""
    return f"""
        WITH RECURSIVE j0 AS (SELECT line_id, {STRICT_JSON} AS j FROM transcript_lines WHERE has_newline),
             l0 AS (SELECT line_id, j ->> '$.uuid' AS uuid, nullif(j ->> '$.parentUuid', '') AS parent FROM j0 WHERE json_type(j) = 'OBJECT' AND coalesce(j ->> '$.uuid', '') <> ''),
             ch AS (SELECT parent AS uuid, min(uuid) AS child FROM l0 WHERE parent IS NOT NULL GROUP BY parent),
             l AS (SELECT line_id, uuid, {parent} AS parent FROM l0 LEFT JOIN ch USING (uuid)),
             o AS (SELECT uuid, min(line_id) AS up FROM l GROUP BY uuid),
             n AS (SELECT line_id, l.parent, up FROM l LEFT JOIN o ON o.uuid = l.parent),
             w(line_id, thread, depth, status) AS (SELECT line_id, line_id, 1, CASE WHEN parent IS NULL THEN 'rooted' ELSE 'orphan' END FROM n WHERE up IS NULL
                 UNION ALL SELECT n.line_id, thread, depth + 1, status FROM n JOIN w ON n.up = w.line_id)
        SELECT line_id, thread, depth, status FROM w UNION ALL SELECT line_id, NULL, NULL, 'cycle' FROM n WHERE line_id NOT IN (SELECT line_id FROM w)"""


SQL = {
    "p3_threads": _threads("parent"),
    "p3_planted": _threads("CASE WHEN parent IS NOT NULL AND line_id % 97 = 0 THEN 'no such record' WHEN parent IS NULL AND line_id % 5 = 0 THEN child ELSE parent END"),
    "p6_invariants": """SELECT DISTINCT container_kind, capacity_tokens, (SELECT count(*) FROM documents) AS items, 0 AS overfull, 0 AS cut, 0 AS torn, 0 AS wasted
        FROM container_sizes WHERE capacity_tokens > 0 AND container_kind IS NOT NULL""",
    "p7_invariants": r"""
        WITH k AS (SELECT nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '') AS source, text FROM documents),
             t AS (SELECT mix_name, nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '') AS source, sum(weight) AS weight, min(greatest(coalesce(max_repeats, 0), 0)) AS cap
                   FROM mix_targets WHERE mix_name IS NOT NULL AND weight > 0 GROUP BY ALL)
        SELECT mix_name, source, round(weight / sum(weight) OVER (PARTITION BY mix_name), 6) AS due_share, true AS reached, true AS capped
        FROM t WHERE cap > 0 AND source IN (SELECT source FROM k WHERE length(text) > 0)""",
    "p8_agreement": """SELECT count(*) AS labels, true AS met FROM (SELECT doc_id FROM doc_labels WHERE label IS NOT NULL GROUP BY doc_id
        HAVING count(*) > 1 AND avg(CAST(lower(trim(label)) = 'prose' AS INTEGER)) IN (0, 1))""",
    "p8_stats": _STATS + """
        SELECT doc_id, lang, n_words, round(mean_word_length, 9) AS mean_word_length, round(symbol_ratio, 9) AS symbol_ratio,
               round(line_end_share, 9) AS line_end_share, round(common_share, 9) AS common_share FROM s""",
    "p8_ranks": _STATS + """,
         l AS (UNPIVOT (SELECT doc_id, lang, CAST(n_words AS DOUBLE) AS n_words, mean_word_length, symbol_ratio, line_end_share, common_share FROM s)
               ON n_words, mean_word_length, symbol_ratio, line_end_share, common_share INTO NAME stat VALUE value)
        SELECT doc_id, lang, stat, rank() OVER (PARTITION BY lang, stat ORDER BY value) - 1 AS n_below,
               count(*) OVER (PARTITION BY lang, stat ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_upto,
               count(*) OVER (PARTITION BY lang, stat) AS n_group FROM l""",
    "p3_found": _KEPT + " SELECT session_id, pos, turn_id FROM o JOIN good USING (session_id)",
    "p3_conversations": _KEPT + " SELECT session_id, pos, turn_id, role, text FROM o JOIN good USING (session_id)",
}
