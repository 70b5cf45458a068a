import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.llm import packing, tokens
from threadlake.llm.tokens import TOKENIZER, encoding

DOCS = "doc_id bigint, text string, item string, n_tokens string, grp string"
KINDS = "container_kind string, capacity_tokens bigint, bin string"


def plain_best_fit(sizes, capacity):
    rooms, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in rooms if r >= sizes[k]]
        room = min(fits, default=None)
        if room is None:
            rooms.append(capacity - sizes[k])
        else:
            rooms.remove(room)
            rooms.append(room - sizes[k])
    return sorted(rooms)


@given(st.integers(1, 200).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, c), max_size=60))))
@settings(max_examples=400, deadline=None)
def test_is_best_fit_decreasing(case):
    capacity, sizes = case
    bins = packing.best_fit_decreasing(np.array(sizes, np.int64), capacity)
    used = np.bincount(bins, weights=sizes) if sizes else np.zeros(0)
    assert sorted(int(capacity - u) for u in used) == plain_best_fit(sizes, capacity)


def check(rows, texts, kinds):
    encode = encoding(TOKENIZER).encode_ordinary
    for kind, capacity in kinds.items():
        mine = [r for r in rows if r.container_kind == kind]
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        for doc, text in texts.items():
            pieces = sorted((r.piece_no, r.token_start, r.n_tokens) for r in mine if r.doc_id == doc)
            n = len(encode(text or ""))
            assert len(pieces) == max(1, -(-n // capacity))  # whole unless too long
            assert [(k, k * capacity, min(capacity, n - k * capacity)) for k in range(len(pieces))] == pieces
            ids = encode(text or "")
            back = encoding(TOKENIZER).decode([t for _, a, m in pieces for t in ids[a : a + m]])
            assert back == (text or "")


def test_pack(spark):
    rng = random.Random(1)
    texts = {k: " ".join(rng.choice(["alpha", "bé", "ไทย", "x1"]) for _ in range(rng.choice([0, 1, 5, 40, 90]))) for k in range(200)} | {500: None, 501: "", 502: "word " * 60_000, 503: "#" * 20_000}
    rows = [(k, t, "a", "b", "c") for k, t in texts.items()]
    kinds = spark.createDataFrame([("s", 64, "x"), ("l", 500, "x"), ("s", 64, "x"), ("zero", 0, "x"), ("none", None, "x")], KINDS)
    packed = packing.pack(spark.createDataFrame(rows, DOCS), kinds)
    check(packed.collect(), texts, {"s": 64, "l": 500})
    report = {r.container_kind: r for r in packing.fill_report(packed).collect()}
    assert set(report) == {"s", "l"} and all(r.fullest <= r.capacity_tokens and r.containers <= 1.15 * r.least_containers + 1 for r in report.values())


def test_groups_lose_little_and_keep_copies(spark):
    rng = random.Random(2)
    rows = [(k // 2, "word " * rng.randrange(1, 60), "", "", "") for k in range(3000)]
    docs, kinds = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("k", 64, "")], KINDS)
    split = packing.pack(docs, kinds, group_items=500)
    assert split.count() == 3000
    one, many = (packing.fill_report(x).first().containers for x in (packing.pack(docs, kinds), split))
    assert many <= one * 1.02 + 1


def test_same_containers_however_the_table_is_split(spark):
    rng = random.Random(3)
    rows = [(k // 2, "word " * rng.randrange(1, 60), "", "", "") for k in range(800)] + [(7, "same", "", "", "")] * 40 + [(None, None, "", "", "")] * 3
    docs, kinds = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("k", 64, ""), ("m", 20, "")], KINDS)
    one, many = (sorted(map(tuple, packing.pack(t, kinds, group_items=300).collect()), key=str) for t in (docs.coalesce(1), docs.repartition(6)))
    assert one == many and len({r[:2] + r[3:7] for r in one}) == len(one)
    assert [(r["items"], r.overfull, r.cut, r.torn) for r in packing.invariants(packing.pack(docs, kinds), docs).collect()] == [(843, 0, 0, 0)] * 2


def test_many_equal_rows_are_numbered_in_blocks(spark):
    tokens.COPY_BLOCK, held = 7, tokens.COPY_BLOCK
    try:
        rows = spark.createDataFrame([(1, 5)] * 50 + [(2, 6)] * 7 + [(None, 1)], "doc_id bigint, text_hash bigint")
        got = sorted((r.doc_id or 0, r.copy_no) for r in tokens.numbered(rows).collect())
    finally:
        tokens.COPY_BLOCK = held
    assert got == [(0, 0)] + [(1, k) for k in range(50)] + [(2, k) for k in range(7)]


@pytest.mark.parametrize("part", ["docs", "kinds"])
def test_empty(spark, part):
    docs, kinds = spark.createDataFrame([(1, "a", "", "", "")], DOCS), spark.createDataFrame([("k", 64, "")], KINDS)
    assert packing.pack(docs.limit(0) if part == "docs" else docs, kinds.limit(0) if part == "kinds" else kinds).count() == 0
