import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.operators import nested

LINES = "line_id bigint, has_newline boolean, raw string, node_path string, at bigint"


def walk(content, prefix, out):
    if isinstance(content, str):
        out.append(("content", prefix + "0"))
    elif isinstance(content, list):
        for k, x in enumerate(content):
            if isinstance(x, (str, dict)):
                out.append(("content", f"{prefix}{k}"))
            if isinstance(x, dict) and "content" in x:
                walk(x["content"], f"{prefix}{k}.", out)


def expected(raw):
    out, message = [], json.loads(raw).get("message")
    if isinstance(message, dict):
        walk(message.get("content"), "", out)
        usage = message.get("usage")
        if isinstance(usage, dict) and isinstance(usage.get("iterations"), list):
            out += [("iteration", str(k)) for k, x in enumerate(usage["iterations"]) if isinstance(x, dict)]
    return out


def kernel(raws):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raws)), pa.int64()), pa.array(raws, pa.string())], names=["k", "t"])
    got = [[] for _ in raws]
    for b in nested._nodes(iter([batch])):
        for k, kind, path in zip(*[c.to_pylist() for c in b.columns]):
            got[k].append((kind, path))
    return [sorted(g) for g in got]


scalars = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet='ab"\\{}[],:é\n', max_size=6)
keys = st.sampled_from(["content", "message", "usage", "iterations", "text", "a\"b", ""])
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(keys, x, max_size=4), max_leaves=25)
content = st.recursive(scalars, lambda x: st.lists(x | st.fixed_dictionaries({"content": x, "input": values}), max_size=4), max_leaves=20)
records = st.fixed_dictionaries({"message": st.fixed_dictionaries({"content": content, "usage": st.fixed_dictionaries({"iterations": st.lists(values, max_size=4)}) | values}) | values})


@given(st.lists(st.tuples(records, st.sampled_from([None, 1]), st.booleans()), min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_kernel_equals_plain_walk(rows):
    raws = [json.dumps(r, indent=i, ensure_ascii=a) for r, i, a in rows]
    assert kernel(raws) == [sorted(expected(r)) for r in raws]


@given(st.lists(st.text(alphabet='{}[]",:\\a1 ', max_size=30), min_size=1, max_size=5), records)
@settings(max_examples=300, deadline=None)
def test_broken_rows_do_not_touch_others(broken, record):
    raw = json.dumps(record)
    mixed = [raw]
    for b in broken:
        mixed += [b, raw]
    assert [kernel(mixed)[k] for k in range(0, len(mixed), 2)] == [sorted(expected(raw))] * (len(broken) + 1)


def test_escaped_repeated_and_spaced_keys():
    raws = [
        '{"message":{"cont\\u0065nt":["a"]}}',
        '{"message":{"content":"x","content":["a","b"]}}',
        '{"message":{"content"' + " " * 50 + ":" + "\n" * 30 + '["a" , {"type":"\\"content\\":["} ]}}',
        '{"message":{"content":"' + "x" * 2_000_000 + '"}}',
        "",
        None,
    ]
    assert kernel(raws) == [[("content", "0")], [("content", "0"), ("content", "1")], [("content", "0"), ("content", "1")], [("content", "0")], [], []]


def test_deep():
    raw = '{"message":{"content":' + '[{"content":' * 300 + '"x"' + "}]" * 300 + "}}"
    assert len(kernel([raw])[0]) == 301


def test_tables(spark):
    raw = {"type": "user", "message": {"role": "user", "content": ["a", None, {"type": "text", "text": 'q"é'}, {"type": "tool_result", "content": [{"type": "text", "text": "in"}]}], "usage": {"input_tokens": 5, "iterations": [{"type": "message", "input_tokens": 3}, 1, {"output_tokens": 10**20}]}}}
    rows = [(1, True, json.dumps(raw), "p", 1), (2, True, "{", "p", 1), (3, False, json.dumps(raw), "p", 1), (4, True, None, "p", 1), (5, True, '{"type":"user","message":null}', "p", 1)]
    lines, types = spark.createDataFrame(rows, LINES), spark.createDataFrame([("user",)], "type_name string")
    got = {(r.line_id, r.node_path): (r.parent_path, r.pos, r.kind, r.block_type, r.text) for r in nested.content(lines, types).collect()}
    assert got == {(1, "0"): (None, 0, "string", None, "a"), (1, "2"): (None, 2, "object", "text", 'q"é'), (1, "3"): (None, 3, "object", "tool_result", None), (1, "3.0"): ("3", 0, "object", "text", "in")}
    usage = {r.node_path: (r.iteration_type, r.input_tokens, r.output_tokens) for r in nested.usage_iterations(lines, types).collect()}
    assert usage == {"0": ("message", 3, None), "2": (None, None, None)}
    assert [(r.line_id, r.role, r.content_kind, r.n_content, r.input_tokens) for r in nested.messages(lines, types).collect()] == [(1, "user", "array", 4, 5)]
    assert nested.nodes(lines, types).count() == 6
    assert nested.nodes(lines.limit(0), types).count() == 0


def test_no_member_is_lost(spark):
    use = {"type": "tool_use", "id": "t1", "name": "Look", "input": {"a": [1, {"b": "}"}], "c": "\"é"}, "cache_control": None}
    result = {"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "image", "source": {"data": "x,y"}}, {"type": "text", "text": "in", "citations": []}]}
    thinking = {"type": "thinking", "thinking": "hm", "signature": "sig"}
    odd = {"type": 5, "id": 7, "content": {"k": 1}, "is_error": "no"}
    usage = {"input_tokens": 5.0, "output_tokens": 12, "cache_read_input_tokens": 0.5, "server_tool_use": {"web": [2]}, "tier": "x", "iterations": [{"type": "message", "input_tokens": 3, "more": {"x": 1}}]}
    raw = json.dumps({"type": "user", "message": {"id": "m1", "role": "assistant", "model": "z", "content": [use, result, thinking, odd, "s"], "usage": usage}}, ensure_ascii=False)
    raw = raw.replace('"output_tokens": 12', '"output_tokens" : 1.2E1 ')
    rows = [(1, True, raw, "p", 1), (2, True, '{"message":{"content":[{"input":{"a":"', "p", 1), (3, True, '{"type":"user","message":{}}', "p", 1)]
    lines, types = spark.createDataFrame(rows, LINES), spark.createDataFrame([("user",)], "type_name string")
    got = {r.node_path: r for r in nested.content(lines, types).collect()}
    rest = {p: r.rest and json.loads(r.rest) for p, r in got.items()}
    assert rest == {"0": {"input": use["input"], "cache_control": None}, "1": None, "1.0": {"source": {"data": "x,y"}}, "1.1": {"citations": []}, "2": {"signature": "sig"}, "3": odd, "4": None}
    assert (got["0"].id, got["0"].name, got["1"].tool_use_id, got["1"].is_error, got["2"].thinking) == ("t1", "Look", "t1", True, "hm")
    assert got["3"].id is None and got["3"].is_error is None and got["0"].is_error is None
    m = {r.line_id: r for r in nested.messages(lines, types).collect()}
    assert (m[1].id, m[1].input_tokens, m[1].output_tokens, m[1].cache_read_input_tokens) == ("m1", 5, 12, None)
    assert json.loads(m[1].server_tool_use) == {"web": [2]} and json.loads(m[1].usage_rest) == {"cache_read_input_tokens": 0.5, "tier": "x"} and json.loads(m[1].rest) == {"model": "z"}
    assert m[3].id is None and m[3].rest is None
    assert [json.loads(r.rest) for r in nested.usage_iterations(lines, types).collect()] == [{"more": {"x": 1}}]


@given(st.lists(st.text(alphabet='{}[]",:\\a1 ', max_size=30) | values.map(json.dumps), min_size=1, max_size=5), records)
@settings(max_examples=150, deadline=None)
def test_rest_next_to_broken_rows(broken, record):
    def run(raws):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(raws)), pa.int64()), pa.array(raws, pa.string())], names=["k", "t"])
        tables = [nested._content(iter([batch])), nested._usage(iter([batch])), nested._message_rows(iter([batch]))]
        return [[tuple(r.values())[1:] for b in t for r in b.to_pylist() if r["line_id"] == len(raws) - 1] for t in tables]

    raw = json.dumps(record)
    assert run([*broken, raw]) == run([raw])
    for table in run([raw]):
        assert all(isinstance(json.loads(r[-1]), dict) for r in table if r[-1] is not None)


def test_counters_of_nineteen_digits(spark):
    raw = ['{"type":"user","message":{"usage":{"input_tokens":9223372036854775807,"output_tokens":-9223372036854775808,"cache_read_input_tokens":9223372036854775808,"cache_creation_input_tokens":1.5e18}}}']
    lines = spark.createDataFrame([(1, True, raw[0])], "line_id bigint, has_newline boolean, raw string")
    r = nested.messages(lines, spark.createDataFrame([("user",)], "type_name string")).first()
    assert (r.input_tokens, r.output_tokens, r.cache_read_input_tokens, r.cache_creation_input_tokens) == (2**63 - 1, -(2**63), None, 1_500_000_000_000_000_000)
