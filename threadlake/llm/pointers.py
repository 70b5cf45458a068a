"""Parent pointers resolved by iterative pointer-jumping joins.

Every node carries a summary of the path between its pointer (exclusive) and itself (inclusive).
In a round each unfinished node looks up the node its pointer names, takes over that node's pointer
and puts that node's summary before its own, so the reach doubles: a path of n nodes takes
log2(n) rounds. Finished nodes leave the rounds; only unfinished ones are joined and rewritten, to a
table in the shared folder, so lineage stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.storage import materialize

#: combine(before, after) of a path: columns of the earlier part, columns of the later part.
Combine = Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]]


def resolve(nodes: DataFrame, summaries: list[str], combine: Combine) -> DataFrame:
    """nodes (node, parent, summaries...) with ``root``, ``status`` and the summaries of the whole
    path from the root. status is rooted, orphan (the path ends at a missing parent; root is the
    last node found) or cycle (no end; root is null and summaries cover an arbitrary stretch).

    Defined cases: a null parent makes a root; node ids must be unique and not null; a node that is
    its own parent is a cycle; an empty table gives no rows."""
    known = nodes.select(F.col("node").alias("__p")).withColumn("__there", F.lit(True))
    linked = nodes.join(known, nodes["parent"] == known["__p"], "left").drop("__p")
    missing = F.col("parent").isNotNull() & F.col("__there").isNull()
    end = F.col("parent").isNull() | missing
    start = linked.select(
        "node",
        F.when(~end, F.col("parent")).alias("ptr"),
        F.when(end, F.col("node")).alias("root"),
        missing.alias("orphan"),
        *summaries,
    )
    state, _ = materialize(start, "pointers")
    done, active, total = [state.filter("ptr is null")], state.filter("ptr is not null"), None
    left, reach = active.count(), 1
    while left:
        total = total or state.count()
        if reach > total:  # longer than any path without a repetition
            break
        everything = active
        for d in done:
            everything = everything.unionByName(d)
        to = everything.select(*[F.col(c).alias(f"__{c}") for c in everything.columns])
        joined = active.join(to, active["ptr"] == to["__node"])
        merged = combine({s: F.col(f"__{s}") for s in summaries}, {s: F.col(s) for s in summaries})
        step = joined.select("node", F.col("__ptr").alias("ptr"), F.col("__root").alias("root"), F.col("__orphan").alias("orphan"), *[merged[s].alias(s) for s in summaries])
        step, _ = materialize(step, "pointers")
        done.append(step.filter("ptr is null"))
        active = step.filter("ptr is not null")
        left, reach = active.count(), reach * 2
    out = active.withColumn("status", F.lit("cycle"))
    for d in done:
        out = out.unionByName(d.withColumn("status", F.when(F.col("orphan"), "orphan").otherwise("rooted")))
    return out.drop("ptr", "orphan")
