"""The log engine's queries in SQL, written apart from the engine, for comparison."""

from __future__ import annotations

AS_OF = 1_785_542_400.0  # 2026-08-01T00:00:00Z
QUERY = 'snapshot "stays readable"'
PHRASES = ["snapshot", "stays readable"]
FALLBACK = "zqxv-not-there ledger wizard"
SHORT = "Is"
NOTE_QUERY = "memory queue"
DELTA_MAX = 14_000
LINT = (r"[a-z]{3}-[0-9a-f]{4}", r"(?:fix|bat)-[0-9a-f]{4}")

_INSTANT = r"'(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)'"
INSTANT_TEXT = _INSTANT
_W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _epoch(c: str) -> str:
    return f"(CASE WHEN regexp_full_match({c}, {_INSTANT}) THEN epoch_us(try_cast({c} AS TIMESTAMPTZ)) / 1e6 END)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_T = "T AS (SELECT * FROM turns WHERE session_id IS NOT NULL)"
_S = "S AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY indexed_at DESC, jsonl_path DESC) AS rn FROM sessions) WHERE rn = 1)"
_H = "H AS (SELECT session_id FROM S WHERE entrypoint = 'sdk-cli')"


def _flag(name: str) -> str:
    return f"coalesce(try_cast(j ->> '$.{name}' AS BOOLEAN), false)"


# the SQL engine lets a comma stand before a closing bracket
STRICT_JSON = r"""CASE WHEN NOT regexp_matches(regexp_replace(raw, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[}\]]') THEN try_cast(raw AS JSON) END"""

_R = f"""R AS (
    SELECT line_id, file_id, line_no, j ->> '$.type' AS type, coalesce(nullif(j ->> '$.sessionId', ''), nullif(j ->> '$.session_id', '')) AS own_session,
           j ->> '$.timestamp' AS ts, nullif(j ->> '$.cwd', '') AS cwd, nullif(j ->> '$.gitBranch', '') AS git_branch, nullif(j ->> '$.entrypoint', '') AS entrypoint,
           {_flag("isSidechain")} AS is_sidechain, {_flag("isMeta")} OR {_flag("isCompactSummary")} OR {_flag("isVisibleInTranscriptOnly")} AS is_meta,
           nullif(j ->> '$.customTitle', '') AS custom_title, nullif(CASE j ->> '$.type' WHEN 'ai-title' THEN j ->> '$.aiTitle' WHEN 'agent-name' THEN j ->> '$.agentName' END, '') AS auto_title, j ->> '$.subtype' AS subtype,
           json_extract(j, '$.message.content') AS content, json_extract(j, '$.message.usage') AS usage
    FROM (SELECT *, {STRICT_JSON} AS j FROM transcript_lines WHERE has_newline) WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
  RT AS (SELECT *, CASE json_type(content) WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(content, '$[*]'), lambda b: b ->> '$.type' = 'text'), lambda b: coalesce(b ->> '$.text', '')), chr(10))
                WHEN 'VARCHAR' THEN content ->> '$' ELSE '' END AS text FROM R),
  I AS (SELECT * FROM (SELECT *, last_value(own_session IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS session_id FROM RT WHERE NOT is_meta) WHERE session_id IS NOT NULL)"""


def _count(low: str, term: str) -> str:
    """Occurrences; right for terms of which no beginning is also an end."""
    return f"(length({low}) - length(replace({low}, '{term}', ''))) // {len(term)}"


def _graded(source: str, columns: list[str], long: list[str], keep: str = "true") -> str:
    """CTEs up to G: rows of source with grade and bm."""
    terms = [t.lower() for t in long]
    longest = max(range(len(long)), key=lambda k: (len(long[k]), k))
    low = [f"lower(coalesce({c}, ''))" for c in columns]
    size = " + ".join(f"greatest(length(coalesce({c}, '')) - 2, 0)" for c in columns)
    has = ["(" + " OR ".join(f"contains({x}, '{t}')" for x in low) + ")" for t in terms]
    f = ", ".join("(" + " + ".join(_count(x, t) for x in low) + f") AS f{k}" for k, t in enumerate(terms))
    rest = [f"h{k}" for k in range(len(terms)) if k != longest] or ["false"]
    idf = lambda k: f"(CASE WHEN ln((nn - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((nn - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END)"
    part = lambda k: f"{idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * size / mean))"
    bm = " + ".join(f"(CASE WHEN best = 2 AND {k} = {longest} THEN 0.0 ELSE {part(k)} END)" for k in range(len(terms)))
    return f"""M AS (SELECT *, {size} AS size, {", ".join(f"{h} AS h{k}" for k, h in enumerate(has))} FROM {source}),
        ST AS (SELECT count(*) AS nn, avg(size) AS mean, {", ".join(f"count(*) FILTER (h{k}) AS n{k}" for k in range(len(terms)))} FROM M),
        GR AS (SELECT *, CASE WHEN {" AND ".join(f"h{k}" for k in range(len(terms)))} THEN 1 WHEN {" AND ".join(rest)} THEN 2 WHEN {str(len(terms) > 1).lower()} AND ({" OR ".join(f"h{k}" for k in range(len(terms)))}) THEN 3 END AS g0
               FROM M WHERE ({" OR ".join(f"h{k}" for k in range(len(terms)))}) AND ({keep})),
        GF AS (SELECT *, {f} FROM GR WHERE g0 IS NOT NULL),
        BE AS (SELECT min(g0) AS best FROM GF),
        G AS (SELECT GF.*, best AS grade, {bm} AS bm FROM GF, BE, ST WHERE g0 <= best)"""


_SEARCH = f"""WITH {_T}, {_S}, {_H}, {_graded("T", ["text"], PHRASES, "NOT coalesce(is_sidechain, false)")},
    WH AS (SELECT *, round((CASE WHEN bm = 0 THEN 1.0 ELSE bm END) / (1 + (CASE WHEN {_epoch("ts")} IS NULL THEN 365.0 ELSE greatest(({AS_OF} - {_epoch("ts")}) / 86400.0, 0.0) END) / 60.0), 9) AS w
           FROM G WHERE session_id NOT IN (SELECT session_id FROM H)),
    RK AS (SELECT session_id, round(max(w) * (1 + 0.15 * ln(1 + count(*))), 6) AS score, count(*) AS hits, arg_max(turn_id, {{'w': w, 't': -turn_id}}) AS best_turn, min(grade) AS grade
           FROM WH WHERE session_id IN (SELECT session_id FROM S) GROUP BY session_id ORDER BY score DESC, session_id LIMIT 8)"""

_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"

_SHOWN = f"""WITH {_T}, SH AS (SELECT * FROM T WHERE NOT coalesce(is_sidechain, false) OR session_id NOT IN (SELECT session_id FROM T WHERE NOT coalesce(is_sidechain, false))),
    N AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(ts, '') = '', coalesce(ts, ''), file_id, seq, turn_id) AS rn FROM SH)"""

_TAGGED = """TG AS (SELECT turn_id, CASE turn_id % 4 WHEN 0 THEN '<system-reminder>' || substr(coalesce(text, ''), 1, 20) || '</system-reminder>' || coalesce(text, '')
        WHEN 1 THEN '<command-name>' || coalesce(text, '') WHEN 2 THEN 'Caveat: The messages below' || chr(10) || coalesce(text, '')
        ELSE coalesce(text, '') || chr(9) || '  ' || repeat(chr(10), 4) || '<task-notification>a</task-notification></task-notification>' END AS text FROM turns)"""

_TAG_NAMES = ["system-reminder", "local-command-stdout", "local-command-caveat", "persisted-output", "task-notification", "command-name", "command-message", "command-args"]


def _pairs(c: str) -> str:
    for tag in _TAG_NAMES:
        c = f"regexp_replace({c}, '(?s)<{tag}>.*?</{tag}>', ' ', 'g')"
    return c


def _blanks(c: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_SEP = r"""["'']?[ \t]*[=:][ \t]*["'']?"""


def _redacted(c: str) -> str:
    rules = [
        (r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_\-]+", r"\1[REDACTED]"),
        (rf"(?i)(api[_-]?key{_SEP})([^\s\x1c-\x1f\"'']+)", r"\1[REDACTED]"),
        (rf"(?i)(password{_SEP})([^\s\x1c-\x1f\"'']+)", r"\1[REDACTED]"),
        (r"""(\b[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=["'']?)([^/~$\s"''][^\s"'']{7,})""", r"\1[REDACTED]"),
        (rf"(?i)((?:client_secret|secret|token){_SEP})([^\s\x1c-\x1f\"'']{{12,}})", r"\1[REDACTED]"),
        (r"(Bearer[ \t]+)([Tt]oken\b)", "\\1\x01\\2"),
        ("(Bearer[ \\t]+)[^\\s\x01]\\S*", r"\1[REDACTED]"),
        ("\x01", ""),
        (r"(^|[^A-Za-z0-9])(?:sk|pk|rk|whsec|stripe)_live_[A-Za-z0-9]+", r"\1[REDACTED]"),
        (r"(^|[^A-Za-z0-9])AKIA[0-9A-Z]{16}", r"\1[REDACTED]"),
        (r"(^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}", r"\1[REDACTED]"),
        (r"(^|[^A-Za-z0-9])xox[abprs]-[A-Za-z0-9\-]{10,}", r"\1[REDACTED]"),
        (r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", "[REDACTED]"),
        (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    ]
    for pattern, mask in rules:
        c = f"regexp_replace({c}, '{pattern}', '{mask}', 'g')"
    return c


_KEY = "coalesce(replace(session_id, '-', ''), '0123456789abcdef0123456789abcdef')"
_SECRET = f"""SE AS (SELECT turn_id, coalesce(text, '') || CASE turn_id % 12 WHEN 0 THEN ' sk-' || {_KEY} || ' task-manager' WHEN 1 THEN ' api_key = "' || {_KEY} || '" ok' WHEN 2 THEN ' Password: ' || {_KEY}
        WHEN 3 THEN ' export SOME_TENANT_KEY=' || {_KEY} || ' MAX_TOKEN=4096' WHEN 4 THEN ' "client_secret": "' || {_KEY} || '"' WHEN 5 THEN ' Bearer ' || {_KEY} || ' and Bearer token prose'
        WHEN 6 THEN ' pk_live_' || {_KEY} || ' go_live_date' WHEN 7 THEN ' AKIA' || upper(substr({_KEY}, 1, 16)) || ' x' WHEN 8 THEN ' ghp_' || {_KEY} WHEN 9 THEN ' xoxb-' || {_KEY}
        WHEN 10 THEN ' eyJ' || {_KEY} || '.eyJ' || {_KEY} || '.' || {_KEY}
        ELSE ' -----BEGIN RSA PRIVATE KEY-----' || chr(10) || {_KEY} || chr(10) || '-----END RSA PRIVATE KEY----- done' END AS text FROM turns)"""


def _leaky(c: str) -> str:
    """The twelve leak rules; what is masked is taken out first, as the engine has no lookaround."""
    m = r"\[REDACTED\]"
    rules = [
        (rf"(^|[^A-Za-z0-9])sk-{m}", r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9]"),
        (rf"(?i)api[_-]?key{_SEP}{m}", rf"(?i)api[_-]?key{_SEP}[^\s\x1c-\x1f\"'']"),
        (rf"(?i)password{_SEP}{m}", rf"(?i)password{_SEP}[^\s\x1c-\x1f\"'']"),
        (rf"""(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=["'']?{m}""", r"""\b[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=["'']?[^/~$\s"''][^\s"'']{7,}"""),
        (rf"(?i)(?:client_secret|secret|token){_SEP}{m}", rf"(?i)(?:client_secret|secret|token){_SEP}[^\s\x1c-\x1f\"'']{{12,}}"),
        (rf"Bearer[ \t]+(?:{m}|[Tt]oken\b)", r"Bearer[ \t]+\S"),
        (rf"_live_{m}", r"(^|[^A-Za-z0-9])(?:sk|pk|rk|whsec|stripe)_live_[A-Za-z0-9]"),
        (None, r"(^|[^A-Za-z0-9])AKIA[0-9A-Z]{16}"),
        (None, r"(^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}"),
        (None, r"(^|[^A-Za-z0-9])xox[abprs]-[A-Za-z0-9\-]{10,}"),
        (None, r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+"),
        (None, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ]
    tests = [f"regexp_matches({c if gone is None else f"regexp_replace({c}, '{gone}', ' ', 'g')"}, '{pattern}')" for gone, pattern in rules]
    return f"coalesce({' OR '.join(tests)}, false)"



_MARKERS = [r"sk-[A-Za-z0-9]", r"api[_-]?key *[=:]", r"Bearer ", r"password *[=:]", r"_live_[A-Za-z0-9]"]

_USED = """B AS (SELECT session_id, file_id, line_no, ts, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs) AS b FROM (SELECT *, json_extract(content, '$[*]') AS bs FROM {source} WHERE type = 'assistant' AND json_type(content) = 'ARRAY')),
    TU AS (SELECT * FROM B WHERE b ->> '$.type' = 'tool_use'),
    U AS (SELECT * EXCLUDE (b), 'tool' AS kind, coalesce(nullif(b ->> '$.name', ''), '?') AS value FROM TU
          UNION ALL SELECT * EXCLUDE (b), 'file', substr({file_path}, 1, 400) FROM TU UNION ALL SELECT * EXCLUDE (b), 'file', substr({path}, 1, 400) FROM TU
          UNION ALL SELECT * EXCLUDE (b), 'file', substr({notebook_path}, 1, 400) FROM TU UNION ALL SELECT * EXCLUDE (b), 'command', substr({command}, 1, 200) FROM TU),
    UV AS (SELECT * FROM U WHERE value IS NOT NULL AND value <> '')"""


def _used(source: str) -> str:
    return _USED.format(source=source, **{k: _redacted(f"(b ->> '$.input.{k}')") for k in ("file_path", "path", "notebook_path", "command")})


_NOTE_TAGS = [t for t in _TAG_NAMES if t != "command-name"]


def _note_text(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<command-name>(.*?)</command-name>', '\\1 ', 'g')"
    for tag in _NOTE_TAGS:
        c = f"regexp_replace({c}, '(?s)<{tag}>.*?</{tag}>', '', 'g')"
    return _strip(rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _note_redacted(c: str) -> str:
    rules = [
        (r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_\-]+", r"\1[REDACTED]"),
        (rf"(?i)api[_-]?key{_SEP}[^\s\x1c-\x1f\"'']+", "[REDACTED-CREDENTIAL]"),
        (rf"(?i)password{_SEP}[^\s\x1c-\x1f\"'']+", "[REDACTED-PASSWORD]"),
        (r"""(\b[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)=["'']?)([^/~$\s"''][^\s"'']{7,})""", r"\1[REDACTED]"),
        (r"(Bearer[ \t]+)([Tt]oken\b)", "\\1\x01\\2"),
        ("(Bearer[ \\t]+)[^\\s\x01]\\S*", r"\1[REDACTED]"),
        ("\x01", ""),
        (r"(^|[^A-Za-z0-9])(?:sk|pk|rk|whsec)_live_[A-Za-z0-9]+", r"\1[REDACTED]"),
        (r"(^|[^A-Za-z0-9])AKIA[0-9A-Z]{16}", r"\1[REDACTED]"),
        (r"(^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}", r"\1[REDACTED]"),
        (r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", "[REDACTED]"),
    ]
    for pattern, mask in rules:
        c = f"regexp_replace({c}, '{pattern}', '{mask}', 'g')"
    return c


def _shortened(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) <= {n} THEN {c} ELSE substr({c}, 1, {n}) || ' ...[+' || (length({c}) - {n}) || ' chars]' END)"


def _cleaned(c: str) -> str:
    return _redacted(_blanks(f"regexp_replace({_pairs(c)}, '(?m)^Caveat: The messages below.*?$', ' ', 'g')"))


def _fold(source: str, out: str) -> str:
    """Session files of the records in source (with their sessions)."""
    return f"""FF{out} AS (SELECT *, CASE WHEN type = 'user' AND NOT is_sidechain AND coalesce(entrypoint, '') <> 'sdk-cli' THEN {_cleaned("text")} END AS said FROM {source} WHERE type IN ('user', 'assistant', 'custom-title', 'ai-title', 'agent-name')),
    F3{out} AS (SELECT *, type IN ('user', 'assistant') AS turn, CASE WHEN length(said) >= 2 AND NOT starts_with(said, '<') THEN substr(said, 1, 400) END AS first_said FROM FF{out}),
    F4{out} AS (SELECT session_id, file_id, arg_max(cwd, line_no) FILTER (cwd IS NOT NULL AND turn) AS cwd, arg_max(git_branch, line_no) FILTER (git_branch IS NOT NULL AND turn) AS git_branch, arg_max(entrypoint, line_no) FILTER (entrypoint IS NOT NULL AND turn) AS entrypoint,
           min(nullif(ts, '')) FILTER (turn) AS started_at, max(nullif(ts, '')) FILTER (turn) AS ended_at,
           arg_max(custom_title, line_no) FILTER (type = 'custom-title' AND custom_title IS NOT NULL) AS custom, arg_min(auto_title, line_no) FILTER (auto_title IS NOT NULL) AS auto,
           arg_min(first_said, line_no) FILTER (first_said IS NOT NULL) AS first_user_msg FROM F3{out} GROUP BY session_id, file_id),
    {out} AS (SELECT * EXCLUDE (custom, auto), {_redacted("coalesce(custom, auto)")} AS title, custom IS NOT NULL AS title_custom FROM F4{out})"""


_FOLD = _fold("I", "FS")

_LISTED = """PR AS (SELECT path, s.size AS size, s.mtime AS mtime FROM (SELECT path, arg_max({'size': size, 'mtime': mtime}, {'l': listed_at, 'm': mtime, 's': size}) AS s FROM file_listing WHERE path IS NOT NULL GROUP BY path)),
    MF AS (SELECT path, p.size AS size, p.mtime AS mtime, p.o AS o FROM (SELECT path, arg_max({'size': size, 'mtime': mtime, 'o': "offset"}, {'r': run_id, 'l': last_scan, 'o': "offset", 's': size, 'm': mtime}) AS p
           FROM files_seen WHERE path IS NOT NULL AND run_id IN (SELECT run_id FROM scan_runs WHERE lower(status) = 'ok') GROUP BY path))"""
_GONE = "GO AS (SELECT session_id FROM S WHERE project = 'kelp-mailer')"

_TIER = """
    WITH e AS (SELECT *, CASE WHEN value >= 176 THEN 2 WHEN value >= 140 THEN 1 ELSE 0 END AS want FROM events),
         c AS (SELECT *, sum(CASE WHEN want = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cycle FROM e),
         k AS (SELECT *, coalesce(max(want) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c)
    SELECT event_id, user_id, want, CASE WHEN want = 1 OR done = 0 THEN 'full' ELSE 'quick' END AS mode FROM k WHERE want > 0 AND want > done"""

_DATED = f"""D AS (SELECT *, {_epoch("ts")} AS epoch, coalesce(subtype = 'compact_boundary', false) AS is_boundary FROM RT)"""
_DELTA = f"""{_DATED}, SI AS (SELECT file_id, min(epoch) + 60.0 AS since FROM D WHERE epoch IS NOT NULL GROUP BY file_id),
    DE AS (SELECT D.*, since FROM D JOIN SI USING (file_id) WHERE epoch > since AND NOT is_sidechain AND NOT is_meta AND type IN ('user', 'assistant'))"""

_USES = f"""B AS (SELECT file_id, line_no, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs) AS b FROM (SELECT *, json_extract(content, '$[*]') AS bs FROM DE WHERE type = 'assistant' AND json_type(content) = 'ARRAY')),
    TU AS (SELECT file_id, line_no, CAST(pos AS INTEGER) AS pos, b ->> '$.name' AS tool, coalesce(nullif(b ->> '$.input.file_path', ''), nullif(b ->> '$.input.notebook_path', '')) AS path, nullif(b ->> '$.input.command', '') AS command FROM B WHERE b ->> '$.type' = 'tool_use'),
    ED AS (SELECT file_id, tool, {_note_redacted("path")} AS value, max({{'line_no': line_no, 'pos': pos}}) AS p FROM TU WHERE tool IN ('Write', 'Edit', 'MultiEdit', 'NotebookEdit', 'WriteFile') AND path IS NOT NULL GROUP BY ALL),
    EL AS (SELECT * FROM (SELECT file_id, tool, value, p.line_no AS line_no, p.pos AS pos, row_number() OVER (PARTITION BY file_id ORDER BY p.line_no DESC, p.pos DESC) AS rn FROM ED) WHERE rn <= 40),
    CM AS (SELECT file_id, line_no, pos, {_note_redacted(_strip(f"regexp_replace(command, '{_W}+', ' ', 'g')"))} AS c FROM TU WHERE tool IN ('Bash', 'Shell') AND command IS NOT NULL),
    CL AS (SELECT file_id, line_no, pos, {_shortened("c", 300)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no DESC, pos DESC) AS rn FROM CM) WHERE rn <= 30)"""

_TYPED = f"""SD0 AS (SELECT file_id, line_no, epoch, {_note_text("text")} AS text FROM DE WHERE type = 'user'),
    SD1 AS (SELECT file_id, line_no, epoch, {_note_redacted("text")} AS text, row_number() OVER (PARTITION BY file_id ORDER BY line_no DESC) AS rn FROM SD0 WHERE text <> '' AND NOT starts_with(text, '[Request interrupted')),
    SD AS (SELECT file_id, line_no, epoch, {_shortened("text", 1500)} AS text, rn FROM SD1 WHERE rn <= 25)"""

_NOTES = "NT AS (SELECT doc_id AS note_id, source AS name, project AS description, text AS body, doc_id AS mtime FROM documents)"

SQL = {
    "search_ranked": _SEARCH + " SELECT * FROM RK",
    "search_indexed": _SEARCH + " SELECT * FROM RK",
    "search_top_turns": _SEARCH + " SELECT session_id, turn_id, place, round(w, 6) AS w FROM (SELECT WH.*, row_number() OVER (PARTITION BY session_id ORDER BY w DESC, turn_id) AS place FROM WH WHERE session_id IN (SELECT session_id FROM RK)) WHERE place <= 3",
    "bm25_scores": f"WITH {_T}, {_graded('T', ['text'], PHRASES)} SELECT turn_id, round(bm, 6) AS bm FROM G",
    "fallback_strategy": f"WITH {_T}, {_graded('T', ['text'], FALLBACK.split())} SELECT turn_id, grade, round(bm, 6) AS bm FROM G",
    "short_term_search": f"WITH {_T} SELECT turn_id, CAST(0.0 AS DOUBLE) AS bm FROM T WHERE contains({_lower('text')}, 'is')",
    "snippet": f"""WITH {_T}, {_graded('T', ['text'], PHRASES)},
        A AS (SELECT turn_id, text, {"least(" + ", ".join(f"CASE WHEN instr(lower(text), '{t}') > 0 THEN instr(lower(text), '{t}') - 1 END" for t in PHRASES) + ")"} AS p FROM G),
        P AS (SELECT turn_id, text, greatest(coalesce(p, 0) - 50, 0) AS s FROM A)
        SELECT turn_id, (CASE WHEN s > 0 THEN '…' ELSE '' END) || {_strip("replace(substr(text, s + 1, 150), chr(10), ' ⏎ ')")} || (CASE WHEN s + 150 < length(text) THEN '…' ELSE '' END) AS snippet FROM P""",
    "memory_search": f"""WITH {_NOTES}, {_graded('NT', ['name', 'description', 'body'], NOTE_QUERY.split())}
        SELECT note_id, {" + ".join(f"CAST(contains(lower(coalesce(name, '') || ' ' || coalesce(description, '')), '{t}') AS INTEGER)" for t in NOTE_QUERY.split())} AS in_head, round(bm, 6) AS bm
        FROM G ORDER BY in_head DESC, bm DESC, mtime DESC, note_id LIMIT 5""",
    "vector_dot": f"SELECT e.vec_id, round({_DOT}, 6) AS sim FROM embeddings e, {_Q}",
    "semantic_sessions": _SEARCH + f""", V AS (SELECT t.session_id, t.turn_id, round({_DOT}, 6) AS sim FROM embeddings e JOIN T t ON t.turn_id = e.vec_id, {_Q} WHERE NOT coalesce(t.is_sidechain, false))
        SELECT session_id, max(sim) AS sim, arg_max(turn_id, {{'s': sim, 't': -turn_id}}) AS turn_id FROM V
        WHERE sim >= 0.05 AND session_id IN (SELECT session_id FROM S WHERE coalesce(entrypoint, '') <> 'sdk-cli') AND session_id NOT IN (SELECT session_id FROM RK)
        GROUP BY session_id ORDER BY sim DESC, session_id LIMIT 3""",
    "semantic_memories": f"SELECT doc_id AS note_id, round({_DOT}, 6) AS sim, source AS name FROM embeddings e JOIN documents ON doc_id = e.vec_id, {_Q} WHERE round({_DOT}, 6) >= 0.05 ORDER BY sim DESC, note_id LIMIT 3",
    "embed_pending": f"""WITH {_T}, {_S} SELECT 't' AS kind, turn_id AS id, ts, substr(text, 1, 2000) AS text FROM T WHERE NOT coalesce(is_sidechain, false) AND length(text) >= 40
        AND session_id IN (SELECT session_id FROM S WHERE coalesce(entrypoint, '') <> 'sdk-cli') AND turn_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT 'm', doc_id, NULL, substr(coalesce(source, '') || chr(10) || coalesce(project, '') || chr(10) || coalesce(text, ''), 1, 2000) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)""",
    "role_filter": f"WITH {_T} SELECT turn_id, role FROM T WHERE role IN ('user', 'assistant')",
    "visibility_filter": f"WITH {_T}, {_S}, {_H} SELECT turn_id FROM T WHERE NOT coalesce(is_sidechain, false) AND session_id NOT IN (SELECT session_id FROM H)",
    "project_like": f"WITH {_S} SELECT session_id, project FROM S WHERE contains({_lower('project')}, 'kiosk')",
    "since_filter": f"WITH {_T} SELECT turn_id, ts FROM T WHERE ts >= '2026-01-01' AND ts <> ''",
    "sessions_grep": f"WITH {_S} SELECT session_id FROM S WHERE contains({_lower('title')}, 'the') OR contains({_lower('first_user_msg')}, 'the')",
    "semi_project": f"WITH {_T}, {_S} SELECT turn_id FROM T WHERE session_id IN (SELECT session_id FROM S WHERE contains({_lower('project')}, 'mailer'))",
    "anti_headless": f"WITH {_T}, {_S}, {_H} SELECT turn_id FROM T WHERE session_id NOT IN (SELECT session_id FROM H)",
    "orphans": f"WITH {_T}, {_S} SELECT turn_id FROM T WHERE NOT EXISTS (SELECT 1 FROM S WHERE S.session_id = T.session_id AND jsonl_exists)",
    "canary_counts": f"WITH {_T}, " + """P(canary, prefix) AS (VALUES ('compact summary', 'This session is being continued from a previous'), ('skill body', 'Base directory for this skill:'),
        ('pipeline payload', '[System Instructions]'), ('after that', 'After that'), ('the next step', 'The next step'))
        SELECT canary, (SELECT count(*) FROM T WHERE role = 'user' AND starts_with(text, prefix)) AS n FROM P""",
    "session_file_fold": f"WITH {_R}, {_FOLD} SELECT * FROM FS",
    "merge_state": f"""WITH {_R}, PS AS (SELECT *, last_value(own_session IGNORE NULLS) OVER (PARTITION BY file_id, line_no <= 10 ORDER BY line_no) AS session_id FROM RT WHERE NOT is_meta),
        P1 AS (SELECT * FROM PS WHERE session_id IS NOT NULL AND line_no <= 10), P2 AS (SELECT * FROM PS WHERE session_id IS NOT NULL AND line_no > 10), {_fold("P1", "A")}, {_fold("P2", "B")}
        SELECT session_id, file_id, coalesce(B.cwd, A.cwd) AS cwd, coalesce(B.git_branch, A.git_branch) AS git_branch, coalesce(B.entrypoint, A.entrypoint) AS entrypoint, least(A.started_at, B.started_at) AS started_at, greatest(A.ended_at, B.ended_at) AS ended_at,
               CASE WHEN B.title_custom THEN B.title ELSE coalesce(A.title, B.title) END AS title, coalesce(A.title_custom, false) OR coalesce(B.title_custom, false) AS title_custom, coalesce(A.first_user_msg, B.first_user_msg) AS first_user_msg
        FROM A FULL JOIN B USING (session_id, file_id)""",
    "sessions_rollup": f"""WITH {_R}, {_FOLD},
        TN AS (SELECT session_id, count(*) FILTER (type = 'user') AS n_user, count(*) FILTER (type = 'assistant') AS n_assistant, sum(length(txt)) AS chars_text
               FROM (SELECT *, CASE WHEN type = 'user' AND coalesce(entrypoint, '') = 'sdk-cli' THEN '' ELSE {_cleaned("text")} END AS txt FROM I WHERE type IN ('user', 'assistant')) WHERE length(txt) >= 2 GROUP BY session_id),
        O AS (SELECT session_id, {", ".join(f"arg_max({c}, {{'e': coalesce(ended_at, ''), 'f': file_id}}) FILTER ({c} IS NOT NULL) AS {c}" for c in ("cwd", "git_branch", "title", "entrypoint"))},
                     arg_min(first_user_msg, {{'s': coalesce(started_at, '~'), 'f': file_id}}) FILTER (first_user_msg IS NOT NULL) AS first_user_msg, min(started_at) AS started_at, max(ended_at) AS ended_at FROM FS GROUP BY session_id)
        SELECT O.*, coalesce(n_user, 0) AS n_user, coalesce(n_assistant, 0) AS n_assistant, CAST(coalesce(chars_text, 0) AS BIGINT) AS chars_text FROM O LEFT JOIN TN USING (session_id)""",
    "touches_agg": f"WITH {_R}, {_used('I')} SELECT session_id, file_id, kind, value, count(*) AS n, arg_min(ts, {{'l': line_no, 'p': pos}}) FILTER (ts IS NOT NULL) AS first_ts, arg_max(ts, {{'l': line_no, 'p': pos}}) FILTER (ts IS NOT NULL) AS last_ts FROM UV GROUP BY ALL",
    "tool_uses_explode": f"WITH {_R}, {_used('I')} SELECT file_id, line_no, CAST(pos AS INTEGER) AS pos, kind, value FROM UV",
    "top_touches": f"WITH {_R}, {_used('I')} SELECT session_id, value, n, place FROM (SELECT session_id, value, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, value) AS place FROM UV WHERE kind = 'tool' GROUP BY session_id, value) WHERE place <= 2",
    "drift_types": f"""WITH {_R} SELECT coalesce(type, '?') AS kind, count(*) AS n, coalesce(type, '?') IN ('user', 'assistant', 'system', 'attachment', 'ai-title', 'custom-title', 'agent-name', 'mode', 'permission-mode', 'file-history-snapshot', 'file-history-delta',
        'last-prompt', 'queue-operation', 'bridge-session', 'atis-latch', 'cost-state', 'frame-link', 'artifact-comment-monitor', 'artifact-autoreact-ledger', 'history-suppression') AS known FROM R GROUP BY 1, 3""",
    "drift_blocks": f"""WITH {_R}, K AS (SELECT coalesce(b ->> '$.type', '?') AS kind FROM (SELECT unnest(json_extract(content, '$[*]')) AS b FROM R WHERE json_type(content) = 'ARRAY') WHERE json_type(b) = 'OBJECT')
        SELECT kind, count(*) AS n, kind IN ('text', 'thinking', 'tool_use', 'tool_result', 'image', 'document', 'server_tool_use', 'advisor_tool_result', 'redacted_thinking') AS known FROM K GROUP BY kind""",
    "stats_totals": f"""WITH {_S} SELECT * FROM (SELECT count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (is_sidechain) AS sidechain FROM turns),
        (SELECT count(*) AS sessions, count(DISTINCT project) AS projects, min(started_at) AS "first", max(ended_at) AS "last" FROM S)""",
    "busiest_projects": f"WITH {_S} SELECT project, count(*) AS n, max(ended_at) AS \"last\" FROM S GROUP BY project ORDER BY n DESC, project NULLS FIRST LIMIT 10",
    "duplicate_turns": f"WITH {_T} SELECT session_id, file_id, seq, count(*) AS copies FROM T GROUP BY ALL HAVING count(*) > 1",
    "verify_counts": f"""WITH {_T}, {_S}, C AS (SELECT session_id, count(*) FILTER (role = 'user') AS counted FROM T GROUP BY session_id)
        SELECT session_id, n_user AS stored, coalesce(counted, 0) AS counted FROM S LEFT JOIN C USING (session_id) WHERE n_user IS DISTINCT FROM coalesce(counted, 0)""",
    "ffill_session": f"WITH {_R} SELECT line_id, session_id FROM I",
    "blocks_text": f"WITH {_R} SELECT line_id, text FROM RT WHERE content IS NOT NULL",
    "last_usage": f"""WITH {_R}, UU AS (SELECT file_id, line_no, usage, list_filter(coalesce(json_extract(usage, '$.iterations[*]'), []), lambda b: b ->> '$.type' = 'message') AS it FROM R WHERE type = 'assistant' AND NOT is_sidechain AND json_type(usage) = 'OBJECT'),
        UL AS (SELECT file_id, line_no, CASE WHEN len(it) > 0 THEN it[-1] ELSE usage END AS u FROM UU),
        UT AS (SELECT file_id, line_no, {" + ".join(f"coalesce(try_cast(u ->> '$.{k}' AS BIGINT), 0)" for k in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))} AS tokens FROM UL)
        SELECT file_id, max(line_no) AS line_no, arg_max(tokens, line_no) AS tokens FROM UT GROUP BY file_id""",
    "sessions_list": f"WITH {_S} SELECT session_id, project, title, ended_at FROM S ORDER BY ended_at DESC NULLS LAST, session_id LIMIT 30",
    "show_ordered": _SHOWN + " SELECT session_id, turn_id, rn FROM N",
    "show_context": _SHOWN + ", A AS (SELECT session_id, arg_min(rn, {'d': abs(line_no - 20), 'r': rn}) AS a FROM N GROUP BY session_id) SELECT session_id, turn_id, rn FROM N JOIN A USING (session_id) WHERE abs(rn - a) <= 2",
    "show_last": _SHOWN + " SELECT session_id, turn_id, rn FROM (SELECT *, max(rn) OVER (PARTITION BY session_id) AS l FROM N) WHERE rn > l - 5",
    "show_head": _SHOWN + " SELECT session_id, turn_id, rn FROM N WHERE rn <= 5",
    "show_text": _SHOWN + """ SELECT session_id, rn, turn_id, role, ts, line_no, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[cut at 200 characters]' ELSE text END AS text
        FROM (SELECT *, max(rn) OVER (PARTITION BY session_id) AS l FROM N) WHERE rn > l - 5""",
    "top_files": f"WITH {_R}, {_used('I')} SELECT session_id, file_id, value, n, place FROM (SELECT session_id, file_id, value, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, value, file_id) AS place FROM UV WHERE kind = 'file' GROUP BY session_id, file_id, value) WHERE place <= 12",
    "resolve_prefixes": f"""WITH {_S}, P AS (SELECT DISTINCT substr(session_id, 1, 3) AS prefix FROM S UNION SELECT 'nothing')
        SELECT prefix, count(S.session_id) AS matches, CASE WHEN count(S.session_id) = 1 THEN min(S.session_id) END AS session_id FROM P LEFT JOIN S ON starts_with(S.session_id, prefix) GROUP BY prefix""",
    "sample_turns": f"WITH {_T} SELECT turn_id FROM T ORDER BY md5(CAST(turn_id AS VARCHAR)), turn_id LIMIT 20",
    "search_json": _SEARCH + """ SELECT '{"session_id":"' || session_id || '","hits":' || hits || ',"best_turn":' || best_turn || ',"grade":' || grade || '}' AS json FROM RK""",
    "note_redact": f"WITH {_SECRET}, NX AS (SELECT turn_id, {_note_text('text')} AS text FROM SE) SELECT turn_id, {_note_redacted('text')} AS text FROM NX",
    "note_tags": f"WITH {_TAGGED} SELECT turn_id, {_note_text('text')} AS text FROM TG",
    "short_forms": f"WITH {_T}, B AS (SELECT *, {_strip('text')} AS t FROM T) SELECT turn_id, string_split(session_id, '-')[1] AS short_id, {_shortened('t', 40)} AS short_text FROM B",
    "embed_notes": """WITH P AS (SELECT doc_id AS note_id, substr(coalesce(source, '') || chr(10) || coalesce(project, '') || chr(10) || coalesce(text, ''), 1, 2000) AS t FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL))
        SELECT note_id, length(t) AS chars, length(t) - length(replace(t, 'e', '')) AS es FROM P""",
    "verify_roundtrip": f"""WITH {_R}, {_T}, {_S}, AG AS (SELECT file_id, line_no, {_cleaned('text')} AS again FROM RT)
        SELECT turn_id, CASE WHEN again IS NULL THEN 'missing' WHEN again = text THEN 'same' ELSE 'different' END AS state FROM T LEFT JOIN AG USING (file_id, line_no) WHERE length(text) > 40 AND session_id IN (SELECT session_id FROM S WHERE jsonl_exists)""",
    "strip_tag_pairs": f"WITH {_TAGGED} SELECT turn_id, {_pairs('text')} AS text FROM TG",
    "collapse_ws": f"WITH {_TAGGED} SELECT turn_id, {_blanks('text')} AS text FROM TG",
    "clean_text": f"""WITH {_TAGGED}, CL AS (SELECT turn_id, {_blanks(f"regexp_replace({_pairs('text')}, '(?m)^Caveat: The messages below.*?$', ' ', 'g')")} AS text FROM TG) SELECT turn_id, {_redacted('text')} AS text FROM CL""",
    "redact_text": f"WITH {_SECRET} SELECT turn_id, {_redacted('text')} AS text FROM SE",
    "leak_audit": f"""WITH {_SECRET}, {_R}, {_used('I')}, AU AS (SELECT 'turns' AS source, text FROM SE UNION ALL SELECT 'cleaned', {_redacted('text')} FROM SE UNION ALL SELECT 'notes', concat_ws(' ', coalesce(source, ''), coalesce(project, ''), coalesce(text, '')) FROM documents
        UNION ALL SELECT 'titles', title FROM sessions UNION ALL SELECT 'touches', value FROM UV)
        SELECT source, count(*) FILTER ({_leaky('text')}) AS n FROM AU GROUP BY source""",
    "marker_hits": f"WITH {_SECRET} SELECT turn_id, {' + '.join(f'''CAST(regexp_matches(text, '{m}') AS INTEGER)''' for m in _MARKERS)} AS markers FROM SE",
    "slugify": f"WITH {_S} SELECT session_id, regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g') AS slug FROM S",
    "project_for": f"""WITH {_S} SELECT session_id, CASE WHEN coalesce(cwd, '') = '' THEN regexp_replace(string_split(jsonl_path, '/')[-2], '^-+', '') WHEN regexp_matches(cwd, '^/(private/)?tmp/[a-z]+-[0-9]+/[^/]+/') THEN regexp_replace(regexp_extract(cwd, '^/(?:private/)?tmp/[a-z]+-[0-9]+/([^/]+)/', 1), '^-+', '')
        WHEN rtrim(cwd, '/') = '/data/desk' THEN 'desk' WHEN starts_with(cwd, '/data/desk/') THEN string_split(substr(cwd, 12), '/')[1] WHEN rtrim(cwd, '/') = '/data' THEN '~' ELSE string_split(rtrim(cwd, '/'), '/')[-1] END AS project FROM S""",
    "local_date": f"""SELECT turn_id, CASE WHEN coalesce(ts, '') = '' THEN '?' WHEN regexp_full_match(ts, {_INSTANT}) AND try_cast(ts AS TIMESTAMPTZ) IS NOT NULL THEN strftime(make_timestamp(epoch_us(try_cast(ts AS TIMESTAMPTZ)) + 25200000000), '%Y-%m-%d') ELSE substr(ts, 1, 10) END AS day,
        CASE WHEN coalesce(ts, '') = '' THEN '' WHEN regexp_full_match(ts, {_INSTANT}) AND try_cast(ts AS TIMESTAMPTZ) IS NOT NULL THEN strftime(make_timestamp(epoch_us(try_cast(ts AS TIMESTAMPTZ)) + 25200000000), '%Y-%m-%d %H:%M') ELSE substr(ts, 1, 16) END AS stamp FROM turns""",
    "age_bucket": f"""SELECT turn_id, CASE WHEN s / 3600.0 < 1 THEN CAST(CAST(round(s / 60.0) AS BIGINT) AS VARCHAR) || ' min' WHEN s / 3600.0 < 48 THEN CAST(CAST(round(s / 3600.0) AS BIGINT) AS VARCHAR) || ' h' ELSE CAST(CAST(round(s / 3600.0 / 24) AS BIGINT) AS VARCHAR) || ' d' END AS age
        FROM (SELECT turn_id, floor({AS_OF} - {_epoch('ts')}) AS s FROM turns) WHERE s IS NOT NULL""",
    "lint_lines": f"""WITH L AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, hit FROM (SELECT doc_id, line_no, regexp_extract(regexp_replace(text, '{LINT[1]}', '', 'g'), '({LINT[0]})', 1) AS hit FROM L) WHERE hit <> ''""",
    "memory_parse": f"""WITH P AS (SELECT doc_id, text, CASE WHEN starts_with(text, '---') AND instr(substr(text, 4), chr(10) || '---') > 0 THEN instr(substr(text, 4), chr(10) || '---') + 3 END AS e FROM documents),
        L AS (SELECT doc_id, text, e, CASE WHEN e IS NOT NULL THEN string_split(substr(text, 4, e - 4), chr(10)) ELSE [] END AS ls FROM P),
        V AS (SELECT doc_id, text, e, list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^name:')), lambda x: {_strip("substr(x, 6)")}), lambda v: v <> '') AS ns,
                     list_transform(list_filter(ls, lambda x: regexp_matches(x, '^description:')), lambda x: {_strip("substr(x, 13)")}) AS ds,
                     list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^\\s*type:')), lambda x: {_strip("regexp_extract(x, '^\\s*type:(.*)$', 1)")}), lambda v: v <> '') AS ts FROM L)
        SELECT doc_id, coalesce(ns[-1], 'doc-' || doc_id) AS name, coalesce(ds[-1], '') AS description, coalesce(ts[1], '') AS mtype, {_strip("CASE WHEN e IS NOT NULL THEN substr(text, e + 4) ELSE text END")} AS body FROM V""",
    "ingest_roundtrip": "SELECT file_id, line_no, true AS has_newline, raw FROM transcript_lines WHERE has_newline",
    "ingest_incremental": "SELECT file_id, line_no, byte_start, coalesce(raw, '') AS raw FROM transcript_lines WHERE has_newline AND file_id IS NOT NULL AND (file_id % 7 <> 0 OR line_no <= 3)",
    "manifest_plan": f"""WITH {_LISTED}, X AS (SELECT PR.path, PR.size, CASE WHEN o IS NULL OR PR.size < MF.size OR MF.mtime > PR.mtime + 1.0 THEN 'restart' WHEN o >= PR.size THEN 'skip' ELSE 'append' END AS action, o FROM PR LEFT JOIN MF USING (path))
        SELECT path, action, CASE WHEN action = 'append' THEN o ELSE 0 END AS from_offset FROM X""",
    "snapshot_diff": f"""WITH {_LISTED} SELECT coalesce(PR.path, MF.path) AS path, CASE WHEN MF.path IS NULL THEN 'add' WHEN PR.path IS NULL THEN 'delete' WHEN PR.size IS NOT DISTINCT FROM MF.size AND PR.mtime IS NOT DISTINCT FROM MF.mtime THEN 'same' ELSE 'change' END AS action
        FROM MF FULL OUTER JOIN PR ON PR.path = MF.path""",
    "forget_antijoin": f"WITH {_T}, {_S}, {_GONE} SELECT turn_id FROM T WHERE session_id NOT IN (SELECT session_id FROM GO)",
    "forget_dry_run": f"""WITH {_T}, {_S}, {_GONE} SELECT 'turns' AS "table", count(*) AS n FROM T WHERE session_id IN (SELECT session_id FROM GO) UNION ALL SELECT 'documents', count(*) FROM documents WHERE session_id IN (SELECT session_id FROM GO)
        UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE session_id IN (SELECT session_id FROM GO)""",
    "forget_tombstones": f"""WITH {_T}, {_S}, {_GONE}, {_LISTED}, TS AS (SELECT DISTINCT path FROM T JOIN files USING (file_id) WHERE path IS NOT NULL AND session_id IN (SELECT session_id FROM GO))
        SELECT path, CASE WHEN path IN (SELECT path FROM TS) THEN 'skip' ELSE 'scan' END AS state FROM PR UNION ALL SELECT path, 'expired' FROM TS WHERE path NOT IN (SELECT path FROM PR)""",
    "drop_restarted": f"""WITH {_T}, {_LISTED}, X AS (SELECT PR.path FROM PR LEFT JOIN MF USING (path) WHERE o IS NULL OR PR.size < MF.size OR MF.mtime > PR.mtime + 1.0)
        SELECT turn_id FROM T JOIN files USING (file_id) WHERE path NOT IN (SELECT path FROM X)""",
    "rebuild_archive": f"""WITH {_T}, {_LISTED} SELECT path, line_id AS id, 'fresh' AS kind FROM transcript_lines JOIN files USING (file_id) WHERE has_newline AND path IN (SELECT path FROM PR)
        UNION ALL SELECT path, turn_id, 'archived' FROM T JOIN files USING (file_id) WHERE path NOT IN (SELECT path FROM PR)""",
    "memory_folders": f"""WITH {_S}, C AS (SELECT DISTINCT cwd, string_split(cwd, '/') AS p FROM S WHERE cwd IS NOT NULL), F AS (SELECT DISTINCT cwd AS folder, 2 AS root FROM S WHERE entrypoint = 'cli' AND cwd IS NOT NULL UNION SELECT '/data/desk', 1),
        U AS (SELECT cwd, n, array_to_string(p[1:len(p) - n], '/') AS folder FROM (SELECT cwd, p, unnest(range(0, least(6, len(p) - 2) + 1)) AS n FROM C WHERE len(p) >= 2))
        SELECT cwd, arg_min(folder, {{'d': n, 'r': root}}) AS hit, arg_min(root, {{'d': n, 'r': root}}) AS root FROM U JOIN F USING (folder) GROUP BY cwd""",
    "stale_notes": f"WITH {_S} SELECT doc_id FROM documents JOIN S USING (session_id) WHERE epoch_us(captured_at) / 1e6 < {_epoch('started_at')}",
    "longest_prefix_project": f"""WITH {_S}, NA AS (SELECT DISTINCT regexp_replace(substr(cwd, 12), '[^A-Za-z0-9]', '-', 'g') AS slug FROM S WHERE cwd LIKE '/data/desk/%'),
        KN AS (SELECT regexp_replace(project, '[^A-Za-z0-9]', '-', 'g') AS k, min(project) AS project FROM S WHERE project IS NOT NULL AND project <> '' GROUP BY 1)
        SELECT slug, arg_max(project, length(k)) AS project FROM NA JOIN KN ON slug = k OR starts_with(slug, k || '-') GROUP BY slug""",
    "tier_alarm": _TIER,
    "tier_alarm_stream": _TIER,
    "tier_alarm_ttl": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN value >= 176 THEN 2 WHEN value >= 140 THEN 1 ELSE 0 END AS want, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        m(user_id, rn, event_id, want, before, done, given) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, 0, 0, CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id FROM e)
            UNION ALL SELECT user_id, rn, event_id, want, before, CASE WHEN want = 0 THEN 0 ELSE greatest(before, want) END, CASE WHEN want > before THEN t ELSE given END
            FROM (SELECT e.user_id, e.rn, e.event_id, e.want, e.t, m.given, CASE WHEN m.done > 0 AND e.t - m.given > 21600000000 THEN 0 ELSE m.done END AS before FROM m JOIN e ON e.user_id = m.user_id AND e.rn = m.rn + 1))
        SELECT event_id, user_id, want, CASE WHEN want = 1 OR before = 0 THEN 'full' ELSE 'quick' END AS mode FROM m WHERE want > before""",
    "thresholds": """WITH w AS (SELECT event_id, (user_id + 100) * 1000 AS w, CAST(value * 10000 AS BIGINT) AS t FROM events), e AS (SELECT event_id, CASE WHEN t > w THEN greatest(w, 1000000) ELSE w END AS w FROM w)
        SELECT event_id, CAST(floor(w * CAST(0.70 AS DOUBLE)) AS BIGINT) AS "full", greatest(CAST(floor(w * CAST(0.88 AS DOUBLE)) AS BIGINT), CAST(floor(w * CAST(0.70 AS DOUBLE)) AS BIGINT) + 1) AS quick FROM e""",
    "cycle_start": f"WITH {_R}, {_DATED} SELECT file_id, round(coalesce(max(epoch) FILTER (is_boundary AND epoch < {AS_OF} - 600), arg_min(epoch, line_no) - 1), 3) AS start FROM D WHERE epoch IS NOT NULL GROUP BY file_id",
    "delta_counts": f"WITH {_R}, {_DELTA} SELECT file_id, count(*) FILTER (type = 'user') AS users, count(*) FILTER (type = 'assistant') AS assistants FROM DE GROUP BY file_id",
    "delta_files": f"WITH {_R}, {_DELTA}, {_USES} SELECT file_id, tool, value, line_no, pos FROM EL",
    "delta_messages": f"""WITH {_R}, {_DELTA}, {_TYPED}, SU AS (SELECT *, sum(length(text)) OVER (PARTITION BY file_id ORDER BY line_no DESC ROWS UNBOUNDED PRECEDING) AS used FROM SD) SELECT file_id, line_no, text FROM SU WHERE used <= {DELTA_MAX} OR rn <= 3""",
    "delta_commands": f"WITH {_R}, {_DELTA}, {_USES} SELECT * FROM CL",
    "delta_report": f"""WITH {_R}, {_DELTA}, {_USES}, {_TYPED},
        HE AS (SELECT file_id, 'After ' || strftime(make_timestamp(CAST(since * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') || ': ' || count(*) || ' records' AS head FROM DE GROUP BY file_id, since),
        AN AS (SELECT file_id, arg_max(b ->> '$.text', {{'l': line_no, 'p': pos}}) AS answer FROM B WHERE b ->> '$.type' = 'text' AND regexp_matches(b ->> '$.text', '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]') GROUP BY file_id),
        AR AS (SELECT file_id, {_shortened("a", 2500)} AS answer FROM (SELECT file_id, {_strip(_note_redacted("answer"))} AS a FROM AN)),
        TA AS (SELECT file_id, head, coalesce((SELECT chr(10) || 'Files:' || chr(10) || string_agg('  ' || tool || ': ' || value, chr(10) ORDER BY line_no, pos) FROM EL WHERE EL.file_id = HE.file_id), '')
                   || coalesce((SELECT chr(10) || 'Commands:' || chr(10) || string_agg('  $ ' || value, chr(10) ORDER BY line_no, pos) FROM CL WHERE CL.file_id = HE.file_id), '')
                   || coalesce((SELECT chr(10) || 'Last answer:' || chr(10) || answer FROM AR WHERE AR.file_id = HE.file_id), '') AS tail FROM HE),
        ME AS (SELECT file_id, line_no, rn, '  [' || strftime(make_timestamp(CAST(epoch * 1000000 AS BIGINT)), '%m-%d %H:%M') || '] ' || text AS line FROM SD),
        MU AS (SELECT ME.*, sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS used FROM ME),
        MK AS (SELECT MU.* FROM MU JOIN TA USING (file_id) WHERE rn <= 3 OR used <= {DELTA_MAX} - length(head) - length(tail) - 10),
        RE AS (SELECT file_id, (SELECT count(*) FROM MK WHERE MK.file_id = TA.file_id) AS n_messages,
                      head || coalesce((SELECT chr(10) || 'Messages:' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) FROM MK WHERE MK.file_id = TA.file_id), '') || tail AS report FROM TA)
        SELECT file_id, CAST(n_messages AS INTEGER) AS n_messages, CASE WHEN length(report) > {DELTA_MAX} THEN substr(report, 1, {DELTA_MAX}) || chr(10) || '[cut]' ELSE report END AS report FROM RE""",
    "note_selection": """WITH n AS (SELECT session_id, CAST(doc_id AS VARCHAR) AS path, doc_id AS mtime, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 WHEN doc_id % 2 = 0 THEN NULL ELSE 2 END AS priority FROM documents WHERE session_id IS NOT NULL)
        SELECT session_id, path, priority FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority, mtime DESC, path) AS rn FROM n WHERE priority IS NOT NULL) WHERE rn = 1""",
}
