"""Problem 6: items of varying length in containers of fixed capacity.

Best-fit decreasing: items come longest first, each goes to the open container with the least room
that still takes it, found in a segment tree over remaining capacities in logarithmic time. The
items are dealt by a hash into groups of about ``GROUP_ITEMS`` and each group is packed on its own;
a group of that many items packs as tightly as the whole but for its last few containers, and no
task holds more than one group. A text longer than the capacity is cut into full pieces, a
container each, and a rest that is packed like any item; nothing else is split.

Items are told apart by (doc_id, text_hash, copy_no), equal rows being numbered, and groups and ties
go by these: the same documents are packed alike on any cluster.

Defined cases. Null and empty texts have no tokens and take no room; they still get a container.
Repeated rows and repeated ids are items of their own. Container kinds with a null or non-positive
capacity are left out; no documents or no kinds give no rows. Ties in size go by the item's
identity. Very long texts are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.tokens import IDENTITY, TOKENIZER, token_counts
from threadlake.storage import broadcast_if_bounded, materialize

#: Items of one group, give or take the hash.
GROUP_ITEMS = 100_000
#: Container kinds joined to an item at once.
KIND_BLOCK = 1_000


class CapacityTree:
    """Open containers by remaining room, with a segment tree that tells which rooms occur."""

    def __init__(self, capacity: int):
        self.base = 1 << max(1, capacity.bit_length())
        self.marks = bytearray(2 * self.base)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_no: int) -> None:
        held = self.bins.setdefault(room, [])
        held.append(bin_no)
        i = room + self.base
        while i and not self.marks[i]:
            self.marks[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, container) with the least room of at least ``need``."""
        marks, i = self.marks, need + self.base
        if not marks[i]:
            while i > 1 and (i & 1 or not marks[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i <<= 1
                if not marks[i]:
                    i += 1
        room = i - self.base
        bin_no = self.bins[room].pop()
        if not self.bins[room]:
            marks[i] = 0
            while i > 1 and not marks[i ^ 1]:
                i >>= 1
                marks[i] = 0
        return room, bin_no


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes at most the capacity."""
    tree, out, opened = CapacityTree(capacity), np.empty(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        found = tree.take(size)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        out[k] = found[1]
        tree.add(found[0] - size, found[1])
    return out


def _pack_group(table: pa.Table) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in (*IDENTITY, "piece_no")])
    sizes = table.column("n_tokens").to_numpy()
    return table.append_column("bin", pa.array(best_fit_decreasing(sizes, int(table.column("capacity_tokens")[0].as_py())), pa.int64()))


_FIELDS = "container_kind string, capacity_tokens bigint, doc_id bigint, text_hash bigint, copy_no bigint, piece_no bigint, n_tokens bigint, grp bigint"


def kind_blocks(container_sizes: DataFrame) -> tuple[DataFrame, int]:
    """(block, kinds): the usable kinds in arrays of about KIND_BLOCK, and the number of blocks."""
    kinds = container_sizes.filter("capacity_tokens > 0 and container_kind is not null").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct()
    n = max(1, -(-kinds.count() // KIND_BLOCK))
    block = F.pmod(F.xxhash64("container_kind", "capacity_tokens"), F.lit(n)).cast("int")
    return kinds.groupBy(block.alias("block")).agg(F.collect_list(F.struct("container_kind", "capacity_tokens")).alias("kinds")), n


def pack(documents: DataFrame, container_sizes: DataFrame, tokenizer: str = TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_kind, container_id, capacity_tokens, doc_id, text_hash, copy_no, piece_no,
    token_start, n_tokens): every document, for every kind of container."""
    kinds, n_blocks = kind_blocks(container_sizes)
    sizes, _ = materialize(token_counts(documents, tokenizer), "tokens")
    n = sizes.count()
    items = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(broadcast_if_bounded(kinds, 100), "block")
    items = items.select(F.explode("kinds").alias("k"), *IDENTITY, F.col("n_tokens").alias("total")).select("k.*", *IDENTITY, "total")
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity_tokens")) - 1, F.lit(0)).cast("bigint")
    pieces = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("capacity_tokens"), F.col("total") - F.col("piece_no") * F.col("capacity_tokens")))
    groups = max(1, -(-n // group_items))
    full = F.col("n_tokens") == F.col("capacity_tokens")
    pieces = pieces.select("container_kind", "capacity_tokens", *IDENTITY, "piece_no", "n_tokens", F.pmod(F.xxhash64(*IDENTITY, "piece_no"), F.lit(groups)).alias("grp"), full.alias("full"))
    packed = pieces.filter(~F.col("full")).drop("full").groupBy("container_kind", "capacity_tokens", "grp").applyInArrow(_pack_group, _FIELDS + ", bin bigint")
    packed = packed.withColumn("container_id", F.format_string("%d-%d", "grp", "bin"))
    alone = pieces.filter("full").withColumn("container_id", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("text_hash"), "copy_no", "piece_no"))
    columns = ["container_kind", "container_id", "capacity_tokens", *IDENTITY, "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("token_start"), "n_tokens"]
    return packed.select(*columns).unionByName(alone.select(*columns))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers used, the fewest any packing could use, tokens, and unused share."""
    per = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return (
        per.groupBy("container_kind", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
        .withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )


def invariants(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """Per kind: the rows of documents packed, and of a sound packing zero each: containers filled
    beyond their capacity, items cut although they fit, items whose pieces are not their whole, and
    containers beyond one in a hundred (and the last of each group) more than any packing needs."""
    kind = ["container_kind", "capacity_tokens"]
    items = packed.groupBy(*kind, *IDENTITY).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("piece_no").alias("last"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    cut = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
    torn = (F.col("last") != F.col("pieces") - 1) | (F.col("end") != F.col("tokens")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens"))))
    per = items.groupBy(*kind).agg(F.count(F.lit(1)).alias("items"), F.count_if(cut).alias("cut"), F.count_if(torn).alias("torn"))
    fill = fill_report(packed)
    over = packed.groupBy(*kind, "container_id").agg(F.sum("n_tokens").alias("used")).groupBy(*kind).agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    groups = max(1, -(-documents.count() // GROUP_ITEMS))
    spare = F.greatest(F.lit(0), F.col("containers") - F.ceil(F.col("least_containers") * 1.01) - 2 * groups).cast("bigint")
    return per.join(over, kind).join(fill.select(*kind, spare.alias("wasted")), kind).select(*kind, "items", "overfull", "cut", "torn", "wasted")
