"""Queries of the general problems 1, 2, 4 and 5, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.plans.log_sql import INSTANT_TEXT, STRICT_JSON
from threadlake.operators import badrows, dense, incremental, nested
from threadlake.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    projects = dense.heavy_keys(table(spark, d, "sessions"), "project", "sessions.project")
    return projects.unionByName(dense.heavy_keys(table(spark, d, "turns"), "session_id", "turns.session_id"))


def p1_project_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per project, with sums of their counts."""
    return dense.dense_aggregate(table(spark, d, "sessions"), "project", n_user=("sum", "n_user"), n_assistant=("sum", "n_assistant"), largest=("max", "bytes_text")).withColumnRenamed("key_value", "project")


def p1_session_totals(spark: SparkSession, d: str) -> DataFrame:
    """Turns per session, with their text lengths and line range."""
    return dense.dense_aggregate(table(spark, d, "turns"), "session_id", chars=("sum", "length(text)"), first_line=("min", "line_no"), last_line=("max", "line_no")).withColumnRenamed("key_value", "session_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_lines(*[table(spark, d, t) for t in ("transcript_lines", "files", "file_listing", "files_seen", "scan_runs")]).select("line_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(table(spark, d, "transcript_lines"), table(spark, d, "record_types"))


def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    return nested.messages(table(spark, d, "transcript_lines"), table(spark, d, "record_types")).drop("server_tool_use", "usage_rest", "rest")


def p4_content(spark: SparkSession, d: str) -> DataFrame:
    return nested.content(table(spark, d, "transcript_lines"), table(spark, d, "record_types")).drop("rest")


def p4_usage(spark: SparkSession, d: str) -> DataFrame:
    return nested.usage_iterations(table(spark, d, "transcript_lines"), table(spark, d, "record_types")).drop("rest")


def p4_rest(spark: SparkSession, d: str) -> DataFrame:
    """(line_id, node_kind, node_path, rest): what has no column in the flat tables, as JSON."""
    lines, types = table(spark, d, "transcript_lines"), table(spark, d, "record_types")
    messages, parts = nested.messages(lines, types), ["server_tool_use", "usage_rest", "rest"]
    named = F.array(*[F.struct(F.lit(n).alias("node_kind"), F.col(n).alias("rest")) for n in parts])
    out = messages.select("line_id", F.inline(named)).select("line_id", F.when(F.col("node_kind") == "rest", "message").otherwise(F.col("node_kind")).alias("node_kind"), F.lit("").alias("node_path"), "rest")
    out = out.unionByName(nested.content(lines, types).select("line_id", F.lit("content").alias("node_kind"), "node_path", "rest"))
    return out.unionByName(nested.usage_iterations(lines, types).select("line_id", F.lit("iteration").alias("node_kind"), "node_path", "rest")).filter("rest is not null")


def _failures(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "record_types")
    return badrows.line_failures(table(spark, d, "transcript_lines"), types).unionByName(badrows.export_failures(table(spark, d, "export_rows"), types))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).select("origin", "row_key")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).select("origin", "row_key", F.array_join("reasons", ",").alias("reasons"))


def p5_loaded_export(spark: SparkSession, d: str) -> DataFrame:
    return badrows.load_export(table(spark, d, "export_rows"), table(spark, d, "record_types"))


def p5_loaded_lines(spark: SparkSession, d: str) -> DataFrame:
    return badrows.load_lines(table(spark, d, "transcript_lines"), table(spark, d, "record_types"))


QUERIES = {f.__name__: f for f in (p1_found, p1_project_totals, p1_session_totals, p2_found, p4_found, p4_messages, p4_content, p4_usage, p4_rest, p5_found, p5_reasons, p5_loaded_export, p5_loaded_lines)}

_FIELD = r"""(?:"(?:[^"]|"")*"|[^",\r\n]*)"""


def _instant(c: str) -> str:
    return f"(regexp_full_match({c}, {INSTANT_TEXT}) AND NOT starts_with({c}, '0000') AND try_cast({c} AS TIMESTAMPTZ) IS NOT NULL)"


def _bare(c: str) -> str:
    return f"""CASE WHEN starts_with({c}, '"') THEN replace(substr({c}, 2, length({c}) - 2), '""', '"') ELSE {c} END"""


_BAD_LINES = f"""LN AS (SELECT line_id, {STRICT_JSON} AS j FROM transcript_lines WHERE has_newline),
    BL AS (SELECT line_id FROM LN WHERE j IS NULL OR json_type(j) <> 'OBJECT' OR json_type(j, '$.type') IS DISTINCT FROM 'VARCHAR' OR (j ->> '$.type') NOT IN (SELECT type_name FROM record_types)
           OR NOT (coalesce(json_type(j, '$.timestamp'), 'NULL') = 'NULL' OR (json_type(j, '$.timestamp') = 'VARCHAR' AND {_instant("(j ->> '$.timestamp')")})))"""

_BLANK = r"'^[\s\p{Z}\x{85}\x1c-\x1f]*$'"

_MESSAGES = "MS AS (SELECT line_id, j -> '$.message' AS m FROM LN WHERE line_id NOT IN (SELECT line_id FROM BL) AND json_type(j, '$.message') = 'OBJECT')"
_TREE = """N(line_id, path, parent, pos, el) AS (
                 SELECT line_id, CAST(k AS VARCHAR), CAST(NULL AS VARCHAR), k, el FROM (SELECT line_id, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS k
                     FROM (SELECT line_id, CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN [m -> '$.content'] WHEN 'ARRAY' THEN json_extract(m, '$.content[*]') ELSE [] END AS l FROM MS))
                 UNION ALL
                 SELECT line_id, path || '.' || k, path, k, el FROM (SELECT line_id, path, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS k
                     FROM (SELECT line_id, path, CASE json_type(el, '$.content') WHEN 'VARCHAR' THEN [el -> '$.content'] WHEN 'ARRAY' THEN json_extract(el, '$.content[*]') ELSE [] END AS l FROM N WHERE json_type(el) = 'OBJECT')))"""


def _text_of(j: str, name: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{name}') = 'VARCHAR' THEN {j} ->> '$.{name}' END AS {name}"


def _count_of(j: str, name: str) -> str:
    v = f"({j} ->> '$.{name}')"
    return f"CASE WHEN json_type({j}, '$.{name}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN coalesce(try_cast(CASE WHEN regexp_full_match({v}, '-?[0-9]+') THEN {v} END AS BIGINT), CASE WHEN try_cast({v} AS DOUBLE) = trunc(try_cast({v} AS DOUBLE)) AND NOT regexp_full_match({v}, '-?[0-9]+') THEN try_cast(try_cast({v} AS DOUBLE) AS BIGINT) END) END AS {name}"


_COUNTERS = ["input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens"]
# one failing cell a reason, as the rules say
_LINE_REASONS = f"""LN AS (SELECT line_id, {STRICT_JSON} AS j FROM transcript_lines WHERE has_newline),
    LR AS (SELECT line_id, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN ['bad_json'] ELSE list_filter([
               CASE WHEN NOT (coalesce(json_type(j, '$.timestamp'), 'NULL') = 'NULL' OR (json_type(j, '$.timestamp') = 'VARCHAR' AND {_instant("(j ->> '$.timestamp')")})) THEN 'bad_timestamp' END,
               CASE WHEN json_type(j, '$.type') IS DISTINCT FROM 'VARCHAR' THEN 'type_not_text' END,
               CASE WHEN json_type(j, '$.type') = 'VARCHAR' AND (j ->> '$.type') NOT IN (SELECT type_name FROM record_types) THEN 'unknown_type' END], lambda x: x IS NOT NULL) END AS reasons FROM LN)"""
_EXPORT = f"""E0 AS (SELECT *, coalesce(regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*'), false) AS sound, regexp_replace(raw, '"(?:[^"]|"")*"', 'q', 'g') AS thin FROM export_rows),
    EX AS (SELECT *, {", ".join(f"""{_bare(f"regexp_extract(raw, '^(?:{_FIELD},){{{{{k}}}}}({_FIELD})', 1)".replace("{{", "{").replace("}}", "}"))} AS f{k}""" for k in range(6))}, length(thin) - length(replace(thin, ',', '')) + 1 AS width FROM E0)"""
_EXPORT_REASONS = f"""ER AS (SELECT row_id, CASE WHEN NOT sound THEN ['bad_quoting'] ELSE list_filter([
               CASE WHEN width >= 2 AND NOT (f1 = '' OR {_instant('f1')}) THEN 'bad_timestamp' END, CASE WHEN f0 NOT IN (SELECT type_name FROM record_types) THEN 'unknown_type' END,
               CASE WHEN width <> 6 THEN 'wrong_width' END], lambda x: x IS NOT NULL) END AS reasons FROM EX)"""

SQL = {
    "p4_messages": f"""
        WITH {_BAD_LINES}, {_MESSAGES}, K AS (SELECT *, coalesce(json_type(m, '$.content'), 'absent') AS k, CASE WHEN json_type(m, '$.usage') = 'OBJECT' THEN m -> '$.usage' END AS u FROM MS)
        SELECT line_id, {_text_of("m", "role")}, CASE k WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'absent' THEN 'absent' ELSE 'other' END AS content_kind,
               CAST(CASE k WHEN 'VARCHAR' THEN 1 WHEN 'ARRAY' THEN json_array_length(m, '$.content') ELSE 0 END AS BIGINT) AS n_content, {", ".join(_count_of("u", c) for c in _COUNTERS)}, {_text_of("m", "id")} FROM K""",
    "p4_content": f"""
        WITH RECURSIVE {_BAD_LINES}, {_MESSAGES}, {_TREE}
        SELECT line_id, path AS node_path, parent AS parent_path, pos, CASE json_type(el) WHEN 'VARCHAR' THEN 'string' ELSE 'object' END AS kind, CASE WHEN json_type(el, '$.type') = 'VARCHAR' THEN el ->> '$.type' END AS block_type,
               CASE json_type(el) WHEN 'VARCHAR' THEN el ->> '$' ELSE CASE WHEN json_type(el, '$.text') = 'VARCHAR' THEN el ->> '$.text' END END AS text, {", ".join(_text_of("el", c) for c in nested.LABELS)},
               CASE WHEN json_type(el, '$.is_error') = 'BOOLEAN' THEN CAST(el ->> '$.is_error' AS BOOLEAN) END AS is_error FROM N WHERE json_type(el) IN ('VARCHAR', 'OBJECT')""",
    "p4_usage": f"""
        WITH {_BAD_LINES}, {_MESSAGES}, IT AS (SELECT line_id, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS k FROM (SELECT line_id, json_extract(m, '$.usage.iterations[*]') AS l FROM MS WHERE json_type(m, '$.usage.iterations') = 'ARRAY'))
        SELECT line_id, CAST(k AS VARCHAR) AS node_path, CASE WHEN json_type(el, '$.type') = 'VARCHAR' THEN el ->> '$.type' END AS iteration_type, {", ".join(_count_of("el", c) for c in _COUNTERS)} FROM IT WHERE json_type(el) = 'OBJECT'""",
    "p5_reasons": f"""WITH {_LINE_REASONS}, {_EXPORT}, {_EXPORT_REASONS}
        SELECT 'transcript_lines' AS origin, line_id AS row_key, array_to_string(reasons, ',') AS reasons FROM LR WHERE len(reasons) > 0 UNION ALL SELECT 'export_rows', row_id, array_to_string(reasons, ',') FROM ER WHERE len(reasons) > 0""",
    "p5_loaded_export": f"""WITH {_EXPORT}, {_EXPORT_REASONS} SELECT row_id, batch_no, f0 AS type, f1 AS timestamp, f2 AS session_id, f3 AS kind, f4 AS value, f5 AS n FROM EX WHERE row_id IN (SELECT row_id FROM ER WHERE len(reasons) = 0)""",
    "p4_found": f"""
        WITH RECURSIVE {_BAD_LINES}, MS AS (SELECT line_id, j -> '$.message' AS m FROM LN WHERE line_id NOT IN (SELECT line_id FROM BL) AND json_type(j, '$.message') = 'OBJECT'),
             N(line_id, path, el) AS (
                 SELECT line_id, CAST(k AS VARCHAR), el FROM (SELECT line_id, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS k
                     FROM (SELECT line_id, CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN [m -> '$.content'] WHEN 'ARRAY' THEN json_extract(m, '$.content[*]') ELSE [] END AS l FROM MS))
                 UNION ALL
                 SELECT line_id, path || '.' || k, el FROM (SELECT line_id, path, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS k
                     FROM (SELECT line_id, path, CASE json_type(el, '$.content') WHEN 'VARCHAR' THEN [el -> '$.content'] WHEN 'ARRAY' THEN json_extract(el, '$.content[*]') ELSE [] END AS l FROM N WHERE json_type(el) = 'OBJECT'))),
             IT AS (SELECT line_id, unnest(l) AS el, generate_subscripts(l, 1) - 1 AS k FROM (SELECT line_id, json_extract(m, '$.usage.iterations[*]') AS l FROM MS WHERE json_type(m, '$.usage.iterations') = 'ARRAY'))
        SELECT line_id, 'content' AS node_kind, path AS node_path FROM N WHERE json_type(el) IN ('VARCHAR', 'OBJECT')
        UNION ALL SELECT line_id, 'iteration', CAST(k AS VARCHAR) FROM IT WHERE json_type(el) = 'OBJECT'""",
    "p5_found": f"""
        WITH {_BAD_LINES}, EX AS (SELECT row_id, raw, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*') AS sound, {_bare(f"regexp_extract(raw, '^{_FIELD}')")} AS type, {_bare(f"regexp_extract(raw, '^{_FIELD},({_FIELD})', 1)")} AS ts,
                length(regexp_replace(raw, '"(?:[^"]|"")*"', 'q', 'g')) - length(replace(regexp_replace(raw, '"(?:[^"]|"")*"', 'q', 'g'), ',', '')) + 1 AS width FROM export_rows)
        SELECT 'transcript_lines' AS origin, line_id AS row_key FROM BL UNION ALL
        SELECT 'export_rows', row_id FROM EX WHERE NOT coalesce(sound AND width = 6 AND type IN (SELECT type_name FROM record_types) AND (ts = '' OR {_instant('ts')}), false)""",
    "p5_loaded_lines": f"""
        WITH {_BAD_LINES} SELECT line_id, file_id, line_no, j ->> '$.type' AS type, j ->> '$.timestamp' AS timestamp, raw FROM transcript_lines JOIN (SELECT DISTINCT line_id, j FROM LN) USING (line_id)
        WHERE has_newline AND line_id NOT IN (SELECT line_id FROM BL)""",
    "p1_found": f"""
        WITH v AS (SELECT 'sessions.project' AS field_name, project AS key_value FROM sessions
                   UNION ALL SELECT 'turns.session_id', session_id FROM turns),
             ok AS (SELECT * FROM v WHERE key_value IS NOT NULL AND NOT regexp_matches(key_value, {_BLANK})),
             c AS (SELECT field_name, key_value, count(*) AS n, sum(count(*)) OVER (PARTITION BY field_name) AS total
                   FROM ok GROUP BY field_name, key_value)
        SELECT field_name, key_value FROM c WHERE n * 20 >= total""",
    "p1_project_totals": """
        SELECT project, count(*) AS n, CAST(sum(n_user) AS BIGINT) AS n_user, CAST(sum(n_assistant) AS BIGINT) AS n_assistant,
               max(bytes_text) AS largest FROM sessions GROUP BY project""",
    "p1_session_totals": """
        SELECT session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(line_no) AS first_line,
               max(line_no) AS last_line FROM turns GROUP BY session_id""",
    "p2_found": """
        WITH listed AS (SELECT path, arg_max({'size': size, 'mtime': mtime}, {'l': listed_at, 'm': mtime, 's': size}) AS s
                        FROM file_listing GROUP BY path),
             pos AS (SELECT path, arg_max({'size': size, 'mtime': mtime, 'o': "offset"},
                                          {'r': run_id, 'l': last_scan, 'o': "offset", 's': size, 'm': mtime}) AS p
                     FROM files_seen WHERE run_id IN (SELECT run_id FROM scan_runs WHERE lower(status) = 'ok') GROUP BY path),
             st AS (SELECT f.file_id, s.size AS size, s.mtime AS mtime, p.size AS psize, p.mtime AS pmtime, p.o AS po
                    FROM listed JOIN files f USING (path) LEFT JOIN pos USING (path)),
             kept AS (SELECT file_id, po FROM st
                      WHERE NOT (size < psize) AND NOT (mtime < pmtime - 1) AND NOT (size = psize AND mtime > pmtime + 1)
                        AND (po = size OR EXISTS (SELECT 1 FROM transcript_lines t WHERE t.file_id = st.file_id AND t.byte_start = st.po)))
        SELECT line_id FROM transcript_lines t JOIN st USING (file_id) LEFT JOIN kept k USING (file_id)
        WHERE has_newline AND (k.po IS NULL OR t.byte_start >= k.po)""",
}
