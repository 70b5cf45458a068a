"""Problem 1: per-key results although a few keys hold most rows.

Dense accumulator arrays. Every input split (equal sizes, whatever the keys) encodes its keys by a
dictionary and adds its rows into numpy arrays indexed by the codes: a hot key costs a split one
array cell, so no task depends on the key distribution. The splits' arrays, cut into blocks by a
hash of the key, are summed by a two-level distributed reduction: first groups of ``FAN`` splits,
then one task per set of blocks. Nothing is collected and no row is shuffled, only array cells, of
which a split has at most one per distinct key.

Defined cases. Keys are compared as stored; null is a key of its own. Sums, minima and maxima skip
null values and are null where a key has none. An empty table gives no rows. Whole-number sums are
64-bit and wrap beyond that. Columns beyond those asked for are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.instants import non_blank

#: Cells held by a split before its arrays are emitted and begun anew; bounds a task's memory.
FLUSH_CELLS = 200_000
#: Blocks the keys are hashed into.
BLOCKS = 256
#: Splits that one first-level reduction adds up.
FAN = 64

_EMPTY = {"sum": 0, "min": np.iinfo(np.int64).max, "max": np.iinfo(np.int64).min}
_SCATTER = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def _unify(keys: pa.Array, cells: list[np.ndarray], hows: list[str]) -> tuple[pa.Array, list[np.ndarray]]:
    """One cell per key: codes from a dictionary of the keys, then scatter-reduce."""
    encoded = keys.dictionary_encode(null_encoding="encode")
    codes, size = encoded.indices.to_numpy(), len(encoded.dictionary)
    out = []
    for cell, how in zip(cells, hows):
        total = np.full(size, _EMPTY[how], np.int64)
        _SCATTER[how].at(total, codes, cell)
        out.append(total)
    return encoded.dictionary, out


def _blocked(keys: pa.Array, cells: list[np.ndarray], fan: int | None, schema: pa.Schema) -> pa.RecordBatch:
    """The cells as one row of arrays per block."""
    block = (pd.util.hash_array(keys.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(BLOCKS)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    block = block[order]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([head, [len(block)]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(order)), *[pa.array(c[order]) for c in cells])]
    own = [pa.array(block[head], pa.int32())] + ([] if fan is None else [pa.array(np.full(len(head), fan), pa.int32())])
    return pa.RecordBatch.from_arrays([*own, *lists], schema=schema)


def _schema(cells: list[str], fan: bool) -> tuple[pa.Schema, str]:
    names = ["block", *(["fan"] if fan else [])]
    arrow = pa.schema([(n, pa.int32()) for n in names] + [("keys", pa.list_(pa.string()))] + [(c, pa.list_(pa.int64())) for c in cells])
    return arrow, ", ".join([f"{n} int" for n in names] + ["keys array<string>"] + [f"{c} array<bigint>" for c in cells])


def _accumulate(hows: list[str], names: list[str]):
    """Map side: the split's dictionary and accumulators. Columns: key, then a value per cell;
    the first cell counts rows, the next ones come in pairs (value cell, count of its values)."""
    schema, _ = _schema(names, fan=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fan = TaskContext.get().partitionId() // FAN
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            encoded = b.column(0).cast(pa.string()).dictionary_encode(null_encoding="encode")
            codes, n = encoded.indices.to_numpy(), len(encoded.dictionary)
            cells = [np.bincount(codes, minlength=n).astype(np.int64)]
            for k in range(1, b.num_columns):
                value, how = b.column(k), hows[2 * k - 1]
                there = pc.is_valid(value).to_numpy(zero_copy_only=False)
                total = np.full(n, _EMPTY[how], np.int64)
                _SCATTER[how].at(total, codes[there], value.drop_null().cast(pa.int64()).to_numpy())
                cells += [total, np.bincount(codes[there], minlength=n).astype(np.int64)]
            held.append((encoded.dictionary, cells))
            size += n
            if size > FLUSH_CELLS:
                keys, cells = _unify(pa.concat_arrays([k for k, _ in held]), [np.concatenate(c) for c in zip(*[c for _, c in held])], hows)
                held, size = [(keys, cells)], len(keys)
                if size > FLUSH_CELLS // 2:
                    yield _blocked(keys, cells, fan, schema)
                    held, size = [], 0
        if held:
            keys, cells = _unify(pa.concat_arrays([k for k, _ in held]), [np.concatenate(c) for c in zip(*[c for _, c in held])], hows)
            yield _blocked(keys, cells, fan, schema)

    return run


def _reduce(hows: list[str], names: list[str], last: bool):
    """Sum blocks of arrays. A task holds only its own blocks' cells, one per distinct key."""
    schema, _ = _schema(names, fan=not last)

    def flat(b: pa.RecordBatch, at: int) -> tuple[pa.Array, list[np.ndarray]]:
        return b.column(at).flatten(), [b.column(k).flatten().to_numpy() for k in range(at + 1, b.num_columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 1 if last else 2
        held: dict[int, tuple[pa.Array, list[np.ndarray]]] = {}
        loose: dict[int, list] = {}
        weight: dict[int, int] = {}

        def settle(fan: int) -> None:
            parts = ([held[fan]] if fan in held else []) + loose.pop(fan, [])
            held[fan] = _unify(pa.concat_arrays([k for k, _ in parts]), [np.concatenate(c) for c in zip(*[c for _, c in parts])], hows)
            weight[fan] = 0

        for b in batches:
            fans = np.zeros(b.num_rows, np.int64) if last else b.column(1).to_numpy()
            for fan in np.unique(fans):
                part = b.filter(pa.array(fans == fan))
                keys, cells = flat(part, first)
                loose.setdefault(fan, []).append((keys, cells))
                weight[fan] = weight.get(fan, 0) + len(keys)
                if weight[fan] > max(FLUSH_CELLS, 2 * len(held[fan][0]) if fan in held else 0):
                    settle(fan)
        for fan in list(weight):
            if loose.get(fan):
                settle(fan)
            keys, cells = held.pop(fan)
            yield _blocked(keys, cells, None if last else int(fan), schema)

    return run


def dense_aggregate(df: DataFrame, key: str, **measures: tuple[str, str]) -> DataFrame:
    """(key_value, n, measures...) of each key. A measure is name=(how, column) with how one of
    sum, min, max over whole numbers; n counts rows."""
    names, hows, columns = ["n"], ["sum"], [F.col(key).cast("string").alias("key_value")]
    for name, (how, column) in measures.items():
        names += [name, f"{name}__n"]
        hows += [how, "sum"]
        columns.append(F.expr(column).cast("bigint").alias(name))
    _, ddl = _schema(names, fan=True)
    _, ddl_last = _schema(names, fan=False)
    partial = df.select(*columns).mapInArrow(_accumulate(hows, names), ddl)
    partial = partial.repartition("block", "fan").mapInArrow(_reduce(hows, names, last=False), ddl)
    total = partial.drop("fan").repartition("block").mapInArrow(_reduce(hows, names, last=True), ddl_last)
    rows = total.select(F.explode(F.arrays_zip("keys", *names)).alias("c")).select(F.col("c.keys").alias("key_value"), *[F.col(f"c.{x}").alias(x) for x in names])
    return rows.select("key_value", "n", *[F.when(F.col(f"{m}__n") > 0, F.col(m)).alias(m) for m in measures])


def heavy_keys(df: DataFrame, key: str, field_name: str, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """(field_name, key_value) of the values that at least share (as a fraction) of the rows
    carry, counting only rows where the key is neither null nor blank."""
    counts = dense_aggregate(df, key).filter(non_blank(F.col("key_value")))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    heavy = counts.join(F.broadcast(total), F.col("n") * share[1] >= F.col("total") * share[0])
    return heavy.select(F.lit(field_name).alias("field_name"), "key_value")
