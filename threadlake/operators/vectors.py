"""Vectors: dot product, the semantic supplement to keyword search, and embedding work lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a program's input is not embedded.
HEADLESS = "sdk-cli"


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null where lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def similar(vectors: DataFrame, query: list[float], threshold: float) -> DataFrame:
    """Rows whose vector is at least so similar, with ``sim`` (6 decimals)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("sim", F.round(dot(F.col("vec"), q), 6)).filter(F.col("sim") >= threshold)


def semantic_sessions(turns: DataFrame, sessions: DataFrame, vectors: DataFrame, query: list[float], threshold: float = 0.60, limit: int = 3, exclude: DataFrame | None = None) -> DataFrame:
    """(session_id, sim, turn_id): the closest main-thread turn of each session, best sessions
    first, without program-fed sessions and those excluded (found by keywords)."""
    hits = similar(vectors, query, threshold).join(turns.filter(~F.coalesce("is_sidechain", F.lit(False))).select("turn_id", "session_id"), "turn_id")
    shown = sessions.filter(F.coalesce("entrypoint", F.lit("")) != HEADLESS).select("session_id").distinct()
    hits = hits.join(shown, "session_id", "left_semi")
    if exclude is not None:
        hits = hits.join(exclude.select("session_id"), "session_id", "left_anti")
    best = hits.groupBy("session_id").agg(F.max("sim").alias("sim"), F.max_by("turn_id", F.struct(F.col("sim"), -F.col("turn_id"))).alias("turn_id"))
    return best.orderBy(F.desc("sim"), "session_id").limit(limit)


def semantic_notes(notes: DataFrame, vectors: DataFrame, query: list[float], threshold: float = 0.60, limit: int = 3) -> DataFrame:
    """(note_id, sim, name): the closest notes."""
    hits = similar(vectors, query, threshold).join(notes.select("note_id", "name"), "note_id")
    return hits.orderBy(F.desc("sim"), "note_id").limit(limit).select("note_id", "sim", "name")


def pending(turns: DataFrame, sessions: DataFrame, vectors: DataFrame, least_chars: int = 40, most_chars: int = 2000, cap: int | None = None) -> DataFrame:
    """(turn_id, ts, text): main-thread turns that still lack a vector, newest first."""
    shown = sessions.filter(F.coalesce("entrypoint", F.lit("")) != HEADLESS).select("session_id").distinct()
    todo = turns.filter(~F.coalesce("is_sidechain", F.lit(False)) & (F.length("text") >= least_chars))
    todo = todo.join(shown, "session_id", "left_semi").join(vectors.select("turn_id"), "turn_id", "left_anti")
    rows = todo.select("turn_id", "ts", F.substring("text", 1, most_chars).alias("text"))
    return rows if cap is None else rows.orderBy(F.desc_nulls_last("ts"), F.desc("turn_id")).limit(cap)


def pending_notes(notes: DataFrame, vectors: DataFrame, most_chars: int = 2000) -> DataFrame:
    """(note_id, text): name, description and body of the notes that still lack a vector."""
    todo = notes.join(vectors.select("note_id"), "note_id", "left_anti")
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("name", "description", "body")])
    return todo.select("note_id", F.substring(text, 1, most_chars).alias("text"))


def worklist(turns: DataFrame, sessions: DataFrame, turn_vectors: DataFrame, notes: DataFrame, note_vectors: DataFrame, cap: int | None = None) -> DataFrame:
    """(kind, id, ts, text): notes (m) and turns (t) that still lack a vector; a cap takes notes
    first, then the newest turns."""
    rows = pending_notes(notes, note_vectors).select(F.lit("m").alias("kind"), F.col("note_id").alias("id"), F.lit(None).cast("string").alias("ts"), "text")
    rows = rows.unionByName(pending(turns, sessions, turn_vectors).select(F.lit("t").alias("kind"), F.col("turn_id").alias("id"), "ts", "text"))
    return rows if cap is None else rows.orderBy("kind", F.desc_nulls_last("ts"), F.desc("id")).limit(cap)


def embed(rows: DataFrame, key: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """(key, vec): texts sent to a user's embedder in batches, in their order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "vec": [list(map(float, v)) for v in embedder(part["text"].tolist())]})

    return rows.select(key, "text").mapInPandas(run, f"{key} bigint, vec array<float>")
