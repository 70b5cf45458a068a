"""Problem 4: nested records as flat tables that keep their parent-child links.

Arrow-buffer flattening: ``functions.jsonscan`` turns the string buffer of a batch into
structural arrays; child tables are emitted level by level from parent-index arrays, keys and
paths are carried by vectorised takes, and no row is parsed on its own. Depth is not limited.

Tables of one record: ``message`` (one row per record with a message object), ``content`` (strings
and objects of message.content and, at any depth, of the ``content`` of such an object) and
``iteration`` (objects of message.usage.iterations). A node's path is the positions from the top
joined by dots, its parent's path is the same without the last one.

Defined cases. A string in place of a list is one element at position 0; null elements, numbers,
booleans and lists inside lists are no nodes but keep their position; an object in place of a list
is no node. Of repeated keys the last counts. What no column and no child table carries stays in
``rest``, a JSON object of the source's own spans (of message.usage: ``usage_rest``): tool input,
signatures, sources, citations, and members of another type than their column's. Null or empty texts give no rows, and neither does
an empty table. Lines are told apart by line_id; a repeated line_id gives its rows once per line.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.jsonscan import Scan
from threadlake.operators.badrows import good_heads, line_heads

#: Bytes of text indexed at once, which bounds the memory of a task.
SLICE_BYTES = 4 << 20

QUOTE, BRACE, BRACKET = ord('"'), ord("{"), ord("[")

NODES = pa.schema([("line_id", pa.int64()), ("node_kind", pa.string()), ("node_path", pa.string())])
NODES_DDL = "line_id bigint, node_kind string, node_path string"
LABELS = ["id", "name", "tool_use_id", "thinking"]
CONTENT = pa.schema([("line_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), ("block_type", pa.string()), ("text", pa.string()), *[(f, pa.string()) for f in LABELS], ("is_error", pa.bool_()), ("rest", pa.string())])
CONTENT_DDL = "line_id bigint, node_path string, parent_path string, pos bigint, kind string, block_type string, text string, " + ", ".join(f"{f} string" for f in LABELS) + ", is_error boolean, rest string"
USAGE_FIELDS = ["input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens"]
USAGE = pa.schema([("line_id", pa.int64()), ("node_path", pa.string()), ("iteration_type", pa.string()), *[(f, pa.int64()) for f in USAGE_FIELDS], ("rest", pa.string())])
USAGE_DDL = "line_id bigint, node_path string, iteration_type string, " + ", ".join(f"{f} bigint" for f in USAGE_FIELDS) + ", rest string"
MESSAGES = pa.schema([("line_id", pa.int64()), ("role", pa.string()), ("content_kind", pa.string()), ("n_content", pa.int64()), *[(f, pa.int64()) for f in USAGE_FIELDS], ("id", pa.string()), ("server_tool_use", pa.string()), ("usage_rest", pa.string()), ("rest", pa.string())])
MESSAGES_DDL = "line_id bigint, role string, content_kind string, n_content bigint, " + ", ".join(f"{f} bigint" for f in USAGE_FIELDS) + ", id string, server_tool_use string, usage_rest string, rest string"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(keys, texts) in slices of about SLICE_BYTES; a longer text is a slice of its own."""
    for b in batches:
        texts = b.column(1).cast(pa.large_string())
        keys = b.column(0).to_numpy(zero_copy_only=False)
        if not len(texts):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield keys[at:to], texts.slice(at, to - at)
            at = to


def _paths(parent: pa.Array | None, pos: np.ndarray) -> pa.Array:
    own = pa.array(pos).cast(pa.string())
    return own if parent is None else pc.binary_join_element_wise(parent, own, ".")


def _object_members(scan: Scan, objects: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(parent, opener) of the members of that name that are objects."""
    parent, value = scan.members(objects, name)
    keep = scan.byte(value) == BRACE
    return parent[keep], scan.container(value[keep])


def _content_levels(scan: Scan, row: np.ndarray, objects: np.ndarray, paths: pa.Array | None = None) -> Iterator[tuple]:
    """(row, paths, parent_paths, pos, value) of each level below the objects' ``content``."""
    while len(objects):
        holder, value = scan.members(objects, "content")
        first = scan.byte(value)
        single = first == QUOTE
        lists = np.flatnonzero(first == BRACKET)
        parent, pos, element = scan.elements(scan.container(value[lists]))
        at = np.concatenate([holder[single], holder[lists][parent]])
        pos = np.concatenate([np.zeros(single.sum(), np.int64), pos])
        element = np.concatenate([value[single], element])
        node = np.isin(scan.byte(element), (QUOTE, BRACE))
        at, pos, element = at[node], pos[node], element[node]
        if not len(at):
            return
        above = None if paths is None else paths.take(pa.array(at))
        below = _paths(above, pos)
        yield row[at], below, above, pos, element
        deeper = scan.byte(element) == BRACE
        row, objects, paths = row[at][deeper], scan.container(element[deeper]), below.filter(pa.array(deeper))


def _messages(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(row, opener) of the message objects."""
    parent, objects = _object_members(scan, scan.roots, "message")
    return scan.row[scan.roots[parent]], objects


def _iterations(scan: Scan, row: np.ndarray, messages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, opener) of the usage iterations."""
    holder, usage = _object_members(scan, messages, "usage")
    parent, value = scan.members(usage, "iterations")
    lists = scan.byte(value) == BRACKET
    owner, pos, element = scan.elements(scan.container(value[lists]))
    real = scan.byte(element) == BRACE
    return row[holder[parent[lists][owner]]][real], pos[real], scan.container(element[real])


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def _text_member(scan: Scan, objects: np.ndarray, name: str, size: int, at: np.ndarray) -> pa.Array:
    """A string member of the objects as a column of ``size`` rows, the objects standing at ``at``."""
    parent, value = scan.members(objects, name)
    text = scan.byte(value) == QUOTE
    where = np.full(size, -1)
    where[at[parent[text]]] = np.arange(text.sum())
    return scan.strings(value[text]).take(pa.array(where, mask=where < 0))


def _whole(text: str) -> int | None:
    """A number of 19 digits, or written with fraction or exponent, if it is a 64-bit integer."""
    x = Decimal(text)
    if x and (x.adjusted() > 18 or x != x.to_integral_value()):
        return None
    return int(x) if -(1 << 63) <= x < 1 << 63 else None


def _count_member(scan: Scan, objects: np.ndarray, name: str) -> pa.Array:
    """An integer member of the objects; null where it is missing or no 64-bit integer."""
    parent, value = scan.members(objects, name)
    number = np.isin(scan.byte(value), np.frombuffer(b"-0123456789", np.uint8))
    text = scan.scalars(value[number])
    count = pc.if_else(pc.match_substring_regex(text, r"^-?[0-9]{1,18}$"), text, None).cast(pa.int64())
    odd = pc.indices_nonzero(pc.match_substring_regex(text, r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]{1,9})?$")).to_numpy()
    odd = odd[count.take(pa.array(odd)).is_null().to_numpy(zero_copy_only=False)]
    if len(odd):
        out = count.to_pylist()
        for k in odd:
            out[k] = _whole(text[k].as_py())
        count = pa.array(out, pa.int64())
    where = np.full(len(objects), -1)
    where[parent[number]] = np.arange(number.sum())
    return count.take(pa.array(where, mask=where < 0))


def _flag_member(scan: Scan, objects: np.ndarray, name: str, size: int, at: np.ndarray) -> pa.Array:
    """A boolean member of the objects as a column of ``size`` rows, the objects standing at ``at``."""
    parent, value = scan.members(objects, name)
    first = np.zeros(size, np.uint8)
    first[at[parent]] = scan.byte(value)
    return pa.array(first == ord("t"), mask=~np.isin(first, (ord("t"), ord("f"))))


def _has(scan: Scan, objects: np.ndarray, name: str, *kinds: int) -> np.ndarray:
    """Of each object, whether the member is of one of the kinds (first bytes of its value)."""
    parent, value = scan.members(objects, name)
    out = np.zeros(len(objects), bool)
    out[parent] = np.isin(scan.byte(value), kinds)
    return out


def _filled(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _placed(column: pa.Array, size: int, at: np.ndarray) -> pa.Array:
    where = np.full(size, -1)
    where[at] = np.arange(len(at))
    return column.take(pa.array(where, mask=where < 0))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _slices(batches):
        scan = Scan(texts)
        row, messages = _messages(scan)
        for at, paths, _, _, _ in _content_levels(scan, row, messages):
            yield _batch(NODES, [keys[at], pa.array(["content"]).take(pa.array(np.zeros(len(at), np.int64))), paths])
        at, pos, _ = _iterations(scan, row, messages)
        yield _batch(NODES, [keys[at], pa.array(["iteration"]).take(pa.array(np.zeros(len(at), np.int64))), _paths(None, pos)])


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _slices(batches):
        scan = Scan(texts)
        for at, paths, above, pos, element in _content_levels(scan, *_messages(scan)):
            objects = np.flatnonzero(scan.byte(element) == BRACE)
            opener = scan.container(element[objects])
            plain = np.full(len(at), -1)
            quoted = np.flatnonzero(scan.byte(element) == QUOTE)
            plain[quoted] = np.arange(len(quoted))
            own = scan.strings(element[quoted]).take(pa.array(plain, mask=plain < 0))
            text = pc.coalesce(own, _text_member(scan, opener, "text", len(at), objects))
            kind = pc.if_else(pa.array(plain >= 0), "string", "object")
            columns = {name: _text_member(scan, opener, name, len(at), objects) for name in ("type", *LABELS)}
            columns["is_error"] = _flag_member(scan, opener, "is_error", len(at), objects)
            carried = {name: _filled(c)[objects] for name, c in (columns | {"text": text}).items()} | {"content": _has(scan, opener, "content", QUOTE, BRACKET)}
            rest = _placed(scan.rest(opener, carried), len(at), objects)
            yield _batch(CONTENT, [keys[at], paths, pa.nulls(len(at), pa.string()) if above is None else above, pos, kind, columns["type"], text, *[columns[f] for f in LABELS], columns["is_error"], rest])


def _usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _slices(batches):
        scan = Scan(texts)
        at, pos, objects = _iterations(scan, *_messages(scan))
        every = np.arange(len(at))
        columns = {"type": _text_member(scan, objects, "type", len(at), every)} | {f: _count_member(scan, objects, f) for f in USAGE_FIELDS}
        yield _batch(USAGE, [keys[at], _paths(None, pos), *columns.values(), scan.rest(objects, {name: _filled(c) for name, c in columns.items()})])


def _message_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _slices(batches):
        scan = Scan(texts)
        row, messages = _messages(scan)
        every = np.arange(len(row))
        parent, value = scan.members(messages, "content")
        first = np.zeros(len(row), np.uint8)
        first[parent] = scan.byte(value)
        kind = pa.array(np.select([first == QUOTE, first == BRACKET, first == BRACE, first == 0], ["string", "array", "object", "absent"], "other"))
        lists = parent[scan.byte(value) == BRACKET]
        owner, _, _ = scan.elements(scan.container(value[scan.byte(value) == BRACKET]))
        n = (first == QUOTE).astype(np.int64)
        n[lists] = np.bincount(owner, minlength=len(lists))
        holder, usage = _object_members(scan, messages, "usage")
        where = np.full(len(row), -1)
        where[holder] = np.arange(len(holder))
        take = pa.array(where, mask=where < 0)
        role, own = (_text_member(scan, messages, name, len(row), every) for name in ("role", "id"))
        counts = {f: _count_member(scan, usage, f) for f in USAGE_FIELDS}
        tools = scan.members(usage, "server_tool_use")
        served = _placed(scan.values(tools[1]), len(usage), tools[0])
        carried = {name: _filled(c) for name, c in (counts | {"server_tool_use": served}).items()} | {"iterations": _has(scan, usage, "iterations", BRACKET)}
        usage_rest = scan.rest(usage, carried)
        rest = scan.rest(messages, {"role": _filled(role), "id": _filled(own), "content": (first == QUOTE) | (first == BRACKET), "usage": where >= 0})
        yield _batch(MESSAGES, [keys[row], role, kind, n, *[c.take(take) for c in counts.values()], own, served.take(take), usage_rest.take(take), rest])


def _of_good_lines(kernel, schema: pa.Schema):
    """The kernel's rows for the lines that problem 5 does not reject for their form, with the line's
    type and timestamp, so that the rest of that judgement needs no join with the flat rows."""
    out_schema = pa.schema([*schema, ("__type", pa.string()), ("__time", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = line_heads(b.column(1).to_pylist())
            good = pa.array([h[0] for h in heads], pa.bool_())
            kinds, times = (pa.array([h[k] for h in heads], pa.string()).filter(good) for k in (1, 2))
            keys, texts = b.column(0).filter(good), b.column(1).filter(good)
            numbered = pa.RecordBatch.from_arrays([pa.array(range(len(keys)), pa.int64()), texts], names=["line_id", "raw"])
            for out in kernel(iter([numbered])):
                at = out.column(0)
                yield pa.RecordBatch.from_arrays([keys.take(at), *out.columns[1:], kinds.take(at), times.take(at)], schema=out_schema)

    return run


def _flatten(lines: DataFrame, types: DataFrame, kernel, schema: pa.Schema, ddl: str) -> DataFrame:
    """The flat rows of the loaded lines. Neither lines nor flat rows are shuffled: whether a line is
    loaded is seen where it is read."""
    finished = lines.filter("has_newline").select(F.col("line_id").cast("bigint"), "raw")
    return good_heads(finished.mapInArrow(_of_good_lines(kernel, schema), ddl + ", __type string, __time string"), types, "__type", "__time")


def nodes(lines: DataFrame, types: DataFrame) -> DataFrame:
    """(line_id, node_kind, node_path) of every content element and usage iteration."""
    return _flatten(lines, types, _nodes, NODES, NODES_DDL)


def content(lines: DataFrame, types: DataFrame) -> DataFrame:
    """Flat content elements with their parent's path, kind, block type and text."""
    return _flatten(lines, types, _content, CONTENT, CONTENT_DDL)


def usage_iterations(lines: DataFrame, types: DataFrame) -> DataFrame:
    """Flat usage iterations with their counters."""
    return _flatten(lines, types, _usage, USAGE, USAGE_DDL)


def messages(lines: DataFrame, types: DataFrame) -> DataFrame:
    """One row per message with its role, kind and number of content elements, and usage."""
    return _flatten(lines, types, _message_rows, MESSAGES, MESSAGES_DDL)
