import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.operators import badrows

TYPES = "type_name string, carries_message boolean"
LINES = "line_id bigint, has_newline boolean, raw string, reasons string, origin string"


def types(spark):
    return spark.createDataFrame([("user", True), ("mode", False), ("user", True), (None, None)], TYPES)


def found(df):
    return {r.row_key: list(r.reasons) for r in df.collect()}


GOOD = [
    '{"type":"user"}',
    ' \t{"type":"user","timestamp":null}\r',
    '{"type":"user","timestamp":"2024-02-29T23:59:59.123Z"}',
    '{"type":"mode","timestamp":"2024-01-01T00:00:00-07:00","x":{"type":"no"}}',
    '{"type":"x","type":"user"}',
    '{"type":"user","n":1e5,"m":-0.5,"s":"\\u00e9"}',
]
BAD = [
    "", " ", None, "null", "[]", '"user"', '{"type":"user"} null', '{"type":"user"}{"type":"user"}', "{'type':'user'}", '{"type":"user",}', '{"type":"user","n":NaN}', '{"type":"user","n":01}',
    '{"type":"us\x01er"}', '{"type":"User"}', '{"type":"user "}', '{"type":null}', "{}", '{"type":["user"]}', '{"type":7}', '{"type":"user","timestamp":""}', '{"type":"user","timestamp":5}',
    '{"type":"user","timestamp":"2023-02-29T00:00:00Z"}', '{"type":"user","timestamp":"2024-01-01T24:00:00Z"}', '{"type":"user","timestamp":"2024-01-01 00:00:00Z"}', '{"type":"user","timestamp":"2024-01-01T00:00:00"}',
    '{"type":"user","timestamp":"2024-01-01T00:00:00Z\\n"}', '{"type":"user","timestamp":"0000-01-01T00:00:00Z"}', '{"type":"user","timestamp":"2024-01-01T00:00:60Z"}',
]


def test_lines(spark):
    rows = [(k, True, raw, "x", "y") for k, raw in enumerate(GOOD + BAD)] + [(900, False, "{", "x", "y"), (901, None, "{", "x", "y"), (902, True, "{", "x", "y"), (902, True, "{", "x", "y")]
    got = found(badrows.line_failures(spark.createDataFrame(rows, LINES), types(spark)))
    assert set(got) == set(range(len(GOOD), len(GOOD) + len(BAD))) | {902}
    assert got[len(GOOD)] == ["bad_json"]


def test_deep_and_long_lines(spark):
    deep = '{"type":"user","a":' + "[" * 60_000 + "]" * 60_000 + "}"
    rows = [(1, True, deep, "", ""), (2, True, deep + "]", "", ""), (3, True, deep[:-1], "", ""), (4, True, json.dumps({"type": "user", "t": "é" * 3_000_000}), "", "")]
    assert set(found(badrows.line_failures(spark.createDataFrame(rows, LINES), types(spark)))) == {2, 3}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.text(alphabet='{}[]",:0e\\', max_size=2))
@settings(max_examples=300, deadline=None)
def test_deep_reader_agrees_with_the_strict_one(value, noise):
    raw = json.dumps(value) + noise
    strict = badrows.read_object(raw)
    deep = badrows._deep_object(raw)
    assert (strict is None) == (deep is None)
    if strict:
        flat = lambda v: type(v) if isinstance(v, (dict, list)) else v
        assert {k: flat(v) for k, v in strict.items()} == {k: flat(v) for k, v in deep.items()}


@pytest.mark.parametrize(
    ("raw", "fields"),
    [
        ("a,b", ["a", "b"]), ("", [""]), (",", ["", ""]), ('"a,b",c', ["a,b", "c"]), ('"a""b"', ['a"b']), ('"a\nb",c', ["a\nb", "c"]), ('"\\",x', ["\\", "x"]), ('""', [""]),
        ('a"b', None), ('"a"b', None), ('"a', None), ('a,"b', None), (' "a"', None), ("a\nb", None), ("a\r", None), ('"a" ,b', None), (None, None),
    ],
)
def test_fields(raw, fields):
    assert badrows.read_fields(raw) == fields


def test_export(spark):
    ok = "user,2024-01-01T00:00:00Z,s,k,v,1"
    rows = [(1, 1, ok), (2, 1, ok.replace("2024-01-01T00:00:00Z", "")), (3, 1, ok + ","), (4, 1, "x" + ok), (5, 1, 'user,2024-13-01T00:00:00Z,s,k,"a""b",1'), (6, 1, 'user,,s,k,a "b",1'), (7, 1, None), (8, 1, "")]
    table = spark.createDataFrame(rows, "row_id bigint, batch_no bigint, raw string")
    got = found(badrows.export_failures(table, types(spark)))
    assert got == {3: ["wrong_width"], 4: ["unknown_type"], 5: ["bad_timestamp"], 6: ["bad_quoting"], 7: ["bad_quoting"], 8: ["unknown_type", "wrong_width"]}
    assert {r.row_id for r in badrows.load_export(table, types(spark)).collect()} == {1, 2}


def test_split_and_empty(spark, monkeypatch):
    lines = spark.createDataFrame([(1, True, '{"type":"user"}', "a", "b"), (2, True, "x", "a", "b")], LINES)
    monkeypatch.setattr(badrows, "is_bounded", lambda *_: False)  # the salted join
    loaded, rejected = badrows.split_rows(lines, "line_id", badrows.line_failures(lines, types(spark)))
    assert [r.line_id for r in loaded.collect()] == [1]
    assert [(r.line_id, list(r.reasons)) for r in rejected.collect()] == [(2, ["bad_json"])]
    assert badrows.line_failures(lines.limit(0), types(spark)).count() == 0
    assert badrows.line_failures(lines, types(spark).limit(0)).count() == 2


def test_loaded_lines_of_every_type(spark):
    rows = [(1, True, '{"type":"user","timestamp":"2024-01-01T00:00:00Z","message":{}}', "", ""), (2, True, '{"type":"mode"}', "", ""), (3, True, "{", "", ""), (4, False, '{"type":"mode"}', "", ""), (5, True, '{"type":"nope"}', "", "")]
    got = badrows.load_lines(spark.createDataFrame(rows, LINES), types(spark)).collect()
    assert sorted((r.line_id, r.type, r.timestamp, r.raw) for r in got) == [(1, "user", "2024-01-01T00:00:00Z", rows[0][2]), (2, "mode", None, rows[1][2])]
