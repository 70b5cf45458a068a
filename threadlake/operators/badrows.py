"""Problem 5: rows that fail to parse, apart with their reasons; all others loaded.

Rows are parsed once (in Arrow batches) into cells ``(origin, row_key, column, kind, value)``. A
rule table is joined to the cells, each rule is evaluated by built-in expressions, failing cells
are aggregated to one row of reasons per bad row, and the clean rows are the anti-join. Only
failing cells are ever shuffled.

Defined cases. Null raw text is a bad record. Of duplicate JSON keys the last counts. Row keys are
taken as they are: repeated keys share their reasons. Rows whose has_newline is null or false are
not judged (an unfinished line is neither bad nor loaded). Empty tables give empty results. Columns
beyond those named are carried by ``split_rows`` and ignored by the judgement.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.instants import is_instant
from threadlake.storage import BROADCAST_ROWS, broadcast_if_bounded, is_bounded

#: Fixed values: (origin, column, rule, argument, reason).
RULES = [
    ("transcript_lines", "record", "kind", "object", "bad_json"),
    ("transcript_lines", "type", "kind", "string", "type_not_text"),
    ("transcript_lines", "type", "known", "", "unknown_type"),
    ("transcript_lines", "timestamp", "absent_or_instant", "", "bad_timestamp"),
    ("export_rows", "record", "kind", "sound", "bad_quoting"),
    ("export_rows", "width", "value", "6", "wrong_width"),
    ("export_rows", "type", "known", "", "unknown_type"),
    ("export_rows", "timestamp", "empty_or_instant", "", "bad_timestamp"),
]

CELLS = pa.schema([("row_key", pa.int64()), ("column", pa.string()), ("kind", pa.string()), ("value", pa.string())])
CELLS_DDL = "row_key bigint, column string, kind string, value string"

#: Salts of the shuffle join that replaces the broadcast of an unbounded list of types.
SALTS = 32

_SPACE = " \t\n\r"
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null')
_FIELD = re.compile(r'(?:"((?:[^"]|"")*)"|([^",\r\n]*))(?:(,)|\Z)')


def _refuse(text: str):
    raise ValueError(text)




def _kind(value) -> str:
    return {str: "string", dict: "object", list: "array", bool: "boolean", type(None): "null"}.get(type(value), "number")


class _Number(str):
    """A JSON number, kept apart from text."""


def _decoder() -> json.JSONDecoder:
    """A strict decoder; built where it is used, as it can't travel to executors."""
    return json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def _deep_object(raw: str) -> dict | None:
    """Strict reading of an object nested too deeply for the recursive decoder: the scalar
    members of the top level, containers as empty ones. None if it is not one strict object."""
    i, n, stack, top, key = 0, len(raw), [], {}, None
    state = "value"  # value | first (after an opener) | key | colon | next
    while True:
        while i < n and raw[i] in _SPACE:
            i += 1
        if i == n:
            return top if state == "end" else None
        c = raw[i]
        if state == "end":
            return None
        if state in ("value", "first") and (state == "value" or stack[-1] == "["):
            if state == "first" and c == "]":
                state = "next"
            elif c in "{[":
                if not stack and c != "{":
                    return None
                if len(stack) == 1 and stack[0] == "{":
                    top[key] = {} if c == "{" else []
                stack.append(c)
                i, state = i + 1, "first"
                continue
            else:
                m = _SCALAR.match(raw, i)
                if not m or not stack:
                    return None
                if len(stack) == 1:
                    top[key] = _decoder().decode(m.group())
                i, state = m.end(), "next"
                continue
        elif state in ("first", "key"):
            if state == "first" and c == "}":
                state = "next"
            else:
                m = _SCALAR.match(raw, i) if c == '"' else None
                if not m:
                    return None
                if len(stack) == 1:
                    key = json.loads(m.group())
                i, state = m.end(), "colon"
                continue
        elif state == "colon":
            if c != ":":
                return None
            i, state = i + 1, "value"
            continue
        if state == "next":
            if c == ",":
                i, state = i + 1, "key" if stack[-1] == "{" else "value"
            elif c == {"{": "}", "[": "]"}[stack[-1]]:
                stack.pop()
                i += 1
                state = "next" if stack else "end"
            else:
                return None


def read_object(raw: str | None, decoder: json.JSONDecoder | None = None) -> dict | None:
    """The members of a text that is exactly one strictly valid JSON object, else None."""
    if raw is None:
        return None
    try:
        value = (decoder or _decoder()).decode(raw.strip(_SPACE))
    except RecursionError:
        return _deep_object(raw)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def read_fields(raw: str | None, delimiter: str = ",") -> list[str] | None:
    """The fields of one delimited record, or None if its quoting is not sound: a quoted field is
    quoted from end to end, inner quotes are doubled, line breaks stand inside quotes only."""
    if raw is None:
        return None
    if '"' not in raw and "\n" not in raw and "\r" not in raw:
        return raw.split(delimiter)
    out, at = [], 0
    while True:
        m = _FIELD.match(raw, at)
        if not m:
            return None
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        if not m[3]:
            return out
        at = m.end()


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, CELLS.types)], schema=CELLS)


def _line_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = _decoder()
    for b in batches:
        rows = []
        for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            record = read_object(raw, decoder)
            if record is None:
                rows.append((key, "record", "other", None))
                continue
            rows.append((key, "record", "object", None))
            for column in ("type", "timestamp"):
                kind = "absent" if column not in record else "number" if isinstance(record[column], _Number) else _kind(record[column])
                rows.append((key, column, kind, str(record[column]) if kind == "string" else None))
        yield _cells(rows)


def line_heads(raws: list[str | None]) -> list[tuple[bool, str | None, str | None]]:
    """Of each text whether it is one strict object whose type is a string and whose timestamp is
    absent, null or a string, and these two. With ``good_heads`` the same judgement as by cells
    and rules, for callers that go on with the text at hand."""
    decoder, out = _decoder(), []
    for raw in raws:
        record = read_object(raw, decoder)
        kind, stamp = (record.get("type"), record.get("timestamp")) if record is not None else (None, None)
        plain = lambda v: isinstance(v, str) and not isinstance(v, _Number)
        out.append((plain(kind) and (stamp is None or plain(stamp)), kind if plain(kind) else None, stamp if plain(stamp) else None))
    return out


def good_heads(rows: DataFrame, types: DataFrame, kind: str, stamp: str) -> DataFrame:
    """rows whose type (column kind) is listed and whose timestamp (column stamp) is null or an
    instant, without these columns."""
    value = rows.withColumnRenamed(kind, "value").filter(F.col(stamp).isNull() | is_instant(F.col(stamp))).drop(stamp)
    names = types.select(F.col("type_name").alias("value")).filter("value is not null").distinct()
    return value.join(broadcast_if_bounded(names), "value", "left_semi").drop("value")


def _export_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fields = read_fields(raw)
            if fields is None:
                rows.append((key, "record", "broken", None))
                continue
            rows.append((key, "record", "sound", None))
            rows.append((key, "width", "number", str(len(fields))))
            rows += [(key, column, "string", value) for column, value in zip(("type", "timestamp"), fields)]
        yield _cells(rows)


def line_cells(lines: DataFrame) -> DataFrame:
    """Cells of the finished lines."""
    finished = lines.filter("has_newline").select(F.col("line_id").cast("bigint"), "raw")
    return finished.mapInArrow(_line_cells, CELLS_DDL).withColumn("origin", F.lit("transcript_lines"))


def export_cells(rows: DataFrame) -> DataFrame:
    """Cells of delimited export rows."""
    return rows.select(F.col("row_id").cast("bigint"), "raw").mapInArrow(_export_cells, CELLS_DDL).withColumn("origin", F.lit("export_rows"))


def _with_known(cells: DataFrame, types: DataFrame) -> DataFrame:
    """cells with ``known``: whether the value is a listed type. The list is broadcast when its
    size is proven small; otherwise cells are salted, as a few types hold most rows."""
    names = types.select(F.col("type_name").alias("value")).filter("value is not null").distinct().withColumn("known", F.lit(True))
    if is_bounded(names, BROADCAST_ROWS):
        return cells.join(F.broadcast(names), "value", "left")
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cells.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")).join(salted, ["value", "salt"], "left").drop("salt")


def failures(cells: DataFrame, types: DataFrame) -> DataFrame:
    """(origin, row_key, reasons) of the rows that break a rule."""
    spark = cells.sparkSession
    rules = spark.createDataFrame(RULES, "origin string, column string, rule string, arg string, reason string")
    judged = _with_known(cells, types).join(F.broadcast(rules), ["origin", "column"])
    value = F.coalesce(F.col("value"), F.lit(""))
    good = (
        F.when(F.col("rule") == "kind", F.col("kind") == F.col("arg"))
        .when(F.col("rule") == "value", value == F.col("arg"))
        .when(F.col("rule") == "known", F.col("known").isNotNull() | (F.col("kind") != "string"))
        .when(F.col("rule") == "absent_or_instant", F.col("kind").isin("absent", "null") | is_instant(F.col("value")))
        .when(F.col("rule") == "empty_or_instant", (value == "") | is_instant(F.col("value")))
    )
    bad = judged.filter(~F.coalesce(good, F.lit(False)))
    return bad.groupBy("origin", "row_key").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def line_failures(lines: DataFrame, types: DataFrame) -> DataFrame:
    return failures(line_cells(lines), types)


def export_failures(rows: DataFrame, types: DataFrame) -> DataFrame:
    return failures(export_cells(rows), types)


def split_rows(rows: DataFrame, key: str, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): rows without a failure, and the failing ones with ``reasons`` (which
    takes the place of a column of that name)."""
    mark = bad.select(F.col("row_key").alias("__key"), "reasons")
    loaded = rows.join(mark.select("__key"), rows[key] == F.col("__key"), "left_anti")
    rest = rows.drop("reasons")
    return loaded, rest.join(mark, rest[key] == F.col("__key")).drop("__key")


def load_export(rows: DataFrame, types: DataFrame) -> DataFrame:
    """The valid export rows as columns."""
    from pyspark.sql.functions import pandas_udf  # noqa: PLC0415

    @pandas_udf("array<string>")
    def fields(raw):
        return raw.map(read_fields)

    loaded, _ = split_rows(rows, "row_id", export_failures(rows, types))
    names = ["type", "timestamp", "session_id", "kind", "value", "n"]
    return loaded.select("row_id", "batch_no", fields("raw").alias("f")).select("row_id", "batch_no", *[F.get("f", F.lit(i)).alias(x) for i, x in enumerate(names)])


def load_lines(lines: DataFrame, types: DataFrame) -> DataFrame:
    """The valid finished lines, of every type, with ``type`` and ``timestamp`` as columns."""
    from pyspark.sql.functions import pandas_udf  # noqa: PLC0415

    @pandas_udf("array<string>")
    def heads(raw):
        decoder = _decoder()
        return raw.map(lambda text: [(read_object(text, decoder) or {}).get(k) for k in ("type", "timestamp")])

    loaded, _ = split_rows(lines.filter("has_newline"), "line_id", line_failures(lines, types))
    kept = [c for c in ("line_id", "file_id", "line_no") if c in lines.columns]
    return loaded.select(*kept, "raw", heads("raw").alias("h")).select(*kept, F.get("h", F.lit(0)).alias("type"), F.get("h", F.lit(1)).alias("timestamp"), "raw")
