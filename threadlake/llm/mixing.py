"""Problem 7: sources mixed to target weights.

Soft membership: every document has a posterior over sources. A document whose source can be read
(ignoring case, blanks and the kind of separator) has all its weight there, however rare that source
is. Where the source is null or blank, a classifier fitted on a bounded sample of the labelled
documents predicts it. Nonnegative rates, the expected number of times a document is taken, are
fitted by distributed projected-gradient least squares: a pass adds up the expected tokens of each
source, the residual against the targets, scaled by the source's mass, is the gradient step, and
every document projects its own rate into [0, cap]. Documents of a readable source share one rate, so
their part of the sums is the source's mass; only documents without a source are passed over again.
Sums are whole numbers (posteriors and rates are multiples of powers of two), so neither their order
nor the number of tasks changes a result.

A rate becomes a whole number of copies exactly: documents of a source come in the order of a hash of
their identity, and the fractions go, as one copy more, to as many of them as their tokens allow; a
document that does not fit is skipped, or put in the place of some before it if that comes closer. The order is cut into cells by the hash; cell sums find
the cell in which the tokens run out, and only that cell (and those after it, if its documents are
too large for what is left) is looked at document by document.

The size of a mix is the largest one its caps allow (or a given number of tokens): weights need
not sum to 1; sources without documents can't get their share, which the others take in
proportion; sources of zero or null weight and documents without target are not taken.

Documents are told apart by (doc_id, text_hash, copy_no), equal rows being numbered, so the selection
is the same on any cluster. Defined cases. Null and empty texts have no tokens and are never taken.
Repeated rows are documents of their own. Of repeated targets of a source in a mix the weights add
up and the smallest cap holds; a null or non-positive cap allows nothing. Empty tables give no rows.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.tokens import IDENTITY, TOKENIZER, encoding, keyed, numbered, token_numbers
from threadlake.storage import broadcast_if_bounded, materialize

#: Labelled documents the classifier is fitted on, at most, and how long they may be for that.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000
DIMENSIONS = 1 << 12
#: Fixed value: the class of the sources that no mix names (no source key has capitals).
OTHER = "OTHER"
#: Units of posteriors, rates and parts of a copy.
POST, RATE, PART = 1 << 16, 1 << 26, 1 << 20
#: Passes of the fit without progress at which it ends, and the relative residual at which it is done.
PATIENCE = 20
CLOSE = 1e-5
#: Documents of a hash cell, about, and the share of a source's tokens that may stay unfilled while
#: there are further cells to look into.
CELL_ROWS = 20_000
OPEN_SHARE = 1e-4

_KEYS = ["mix_name", "source"]


def source_key(c: Column) -> Column:
    """A source name read loosely: case, outer blanks, and hyphens or blanks for underscores; null
    for a blank one."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), F.lit(""))


def merged_targets(mix_targets: DataFrame) -> DataFrame:
    """(mix_name, source, weight, cap) with a positive weight, one row per source of a mix."""
    rows = mix_targets.filter("mix_name is not null and source is not null and weight > 0").select("mix_name", source_key(F.col("source")).alias("source"), "weight", "max_repeats")
    cap = F.min(F.coalesce(F.greatest("max_repeats", F.lit(0)), F.lit(0))).cast("bigint")
    return rows.filter("source is not null").groupBy(*_KEYS).agg(_ordered_sum("weight").alias("weight"), cap.alias("cap"))


def _ordered_sum(column: str) -> Column:
    """A sum of fractions that does not depend on the order of the rows (few, of one target)."""
    return F.aggregate(F.array_sort(F.collect_list(column)), F.lit(0.0), lambda a, x: a + x)


def _vector(text: str) -> np.ndarray:
    """Hashed words and line beginnings, as a unit vector."""
    x = np.zeros(DIMENSIONS)
    for w in text.lower().split():
        x[zlib.crc32(w.encode()) % DIMENSIONS] += 1
    for line in text.splitlines():
        x[zlib.crc32(b"^" + line[:2].encode()) % DIMENSIONS] += 1
    x = np.log1p(x)
    return x / (np.linalg.norm(x) or 1)


def fit_classifier(texts: list[str], labels: list[int], classes: int, rounds: int = 80) -> np.ndarray:
    """Weights of a multinomial logistic regression (classes x dimensions and intercept)."""
    x = np.array([np.append(_vector(t), 1.0) for t in texts]).reshape(len(texts), DIMENSIONS + 1)
    y = np.eye(classes)[labels] if texts else np.zeros((0, classes))
    w = np.zeros((classes, DIMENSIONS + 1))
    for _ in range(rounds if texts else 0):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 4.0 * ((p - y).T @ x / len(texts) + 1e-4 * w)
    return w


def posterior(text: str, weights: np.ndarray) -> np.ndarray:
    z = weights @ np.append(_vector(text), 1.0)
    p = np.exp(z - z.max())
    return p / p.sum()


def _units(p: np.ndarray) -> np.ndarray:
    """A posterior in whole units that sum to POST."""
    u = np.rint(p * POST).astype(np.int64)
    u[p.argmax()] += POST - u.sum()
    return u


def _members(path: str, weights: np.ndarray):
    """Arrow batches of (doc_id, hash, text, source) to tokens and, without source, posteriors."""
    post_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("classes", post_type), ("units", post_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            texts = b.column(2).to_pylist()
            classes, units = [], []
            for text, known in zip(texts, b.column(3).is_valid().to_pylist()):
                if known or not len(weights):
                    classes.append(None)
                    units.append(None)
                    continue
                u = _units(posterior(text or "", weights))
                at = np.flatnonzero(u)
                classes.append(at.tolist())
                units.append(u[at].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(token_numbers(encode, texts), pa.int64()), pa.array(classes, post_type), pa.array(units, post_type)], schema=schema)

    return run


def soft_members(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents with a source (doc_id, text_hash, source, n_tokens, copy_no), those without one (the
    same with classes and units of their posterior for source), and the class names. Classes are
    the sources of the labelled sample, those that no mix names being one, OTHER."""
    key = source_key(F.col("source"))
    named = targets.select(F.col("source").alias("s")).distinct().withColumn("named", F.lit(True))
    names, weights = [], np.zeros((0, DIMENSIONS + 1))
    if documents.filter(key.isNull()).limit(1).count():
        labelled = documents.filter(key.isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text", key.alias("s"))
        sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample_rows).join(broadcast_if_bounded(named), "s", "left").select("text", F.when(F.col("named"), F.col("s")).otherwise(OTHER).alias("s")).collect()
        sample.sort(key=lambda r: (r.s, r.text))
        names = sorted({r.s for r in sample})
        weights = fit_classifier([r.text for r in sample], [names.index(r.s) for r in sample], len(names))
    ddl = "doc_id bigint, text_hash bigint, source string, n_tokens bigint, classes array<int>, units array<int>"
    rows = keyed(documents, key.alias("source")).select("doc_id", "text_hash", "text", "source").mapInArrow(_members(tokenizer, weights), ddl)
    rows, _ = materialize(rows.filter("n_tokens > 0"), "members")
    known = numbered(rows.filter("source is not null").select("doc_id", "text_hash", "source", "n_tokens"))
    soft = rows.filter("source is null and classes is not null").select("doc_id", "text_hash", "n_tokens", "classes", "units")
    soft = numbered(soft, [("classes", F.any_value("classes")), ("units", F.any_value("units"))])
    return materialize(known, "known")[0], soft if not names else materialize(soft, "soft")[0], names


def goals(targets: DataFrame, known: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(mix_name, source, cap, mass, goal): the tokens each source that has any is to give. A source
    that is only guessed at does not bound the size of the mix."""
    mass = known.groupBy("source").agg(F.sum("n_tokens").alias("mass"))
    rows = targets.join(mass, "source").filter("mass > 0 and cap > 0")
    mix = Window.partitionBy("mix_name").orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.col("weight") / F.sum("weight").over(mix)
    rows = rows.withColumn("share", share).withColumn("size", F.min(F.col("mass") * F.col("cap") / F.col("share")).over(mix))
    if total_tokens is not None:
        rows = rows.withColumn("size", F.least("size", F.lit(float(total_tokens))))
    return materialize(rows.select(*_KEYS, "cap", "mass", (F.col("share") * F.col("size")).alias("goal")), "goals")[0]


def _soft_rates(classes: pa.Array, units: pa.Array, x: np.ndarray, caps: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents (rows) in mixes (columns), and their likeliest class. Only documents
    whose likeliest class the mix wants are taken. All products are exact."""
    post = np.zeros((len(classes), x.shape[1]))
    post[np.repeat(np.arange(len(classes)), np.diff(classes.offsets.to_numpy())), classes.flatten().to_numpy()] = units.flatten().to_numpy() / POST
    best = post.argmax(1)
    rate = np.minimum(np.clip(post @ x.T, 0, post @ caps.T), caps[:, best].T)
    return np.where(wanted[:, best].T, np.rint(rate * RATE) / RATE, 0.0), best


def _soft_sums(x: np.ndarray, caps: np.ndarray, wanted: np.ndarray):
    """Expected tokens, in units of a millionth of one, by (mix, class) of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(x.shape, np.int64)
        for b in batches:
            if b.num_rows:
                rate, _ = _soft_rates(b.column(1), b.column(2), x, caps, wanted)
                owner = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
                share = b.column(2).flatten().to_numpy() / POST * b.column(0).to_numpy()[owner]
                for m in range(len(x)):
                    np.add.at(total[m], b.column(1).flatten().to_numpy(), np.rint(share * rate[owner, m] * 1e6).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["sums"])

    return run


def fit_rates(soft: DataFrame, rows: list, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, float]:
    """(mixes, rates, caps, wanted, residual) of the classes, by projected gradient steps. rows:
    goals of the sources among the classes; residual: the largest relative one of a mix."""
    mixes = sorted({r.mix_name for r in rows})
    goal, caps, mass = (np.zeros((len(mixes), len(names))) for _ in range(3))
    for r in rows:
        at = mixes.index(r.mix_name), names.index(r.source)
        goal[at], caps[at], mass[at] = r.goal, r.cap, r.mass
    wanted = goal > 0
    narrow = soft.select("n_tokens", "classes", "units")

    def soft_sums(x: np.ndarray) -> np.ndarray:
        cells = narrow.mapInArrow(_soft_sums(x, caps, wanted), "sums array<bigint>").select(F.posexplode("sums").alias("k", "v"))
        out = np.zeros(x.size)
        for r in cells.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            out[r.k] = float(r.v) / 1e6
        return out.reshape(x.shape)

    scale = np.maximum(mass + np.where(wanted, soft_sums(np.where(wanted, 1.0, 0.0)), 0), 1e-300)
    x = np.where(wanted, np.rint(np.minimum(goal / scale, caps) * RATE) / RATE, 0)
    best, least, idle = x, np.inf, 0
    while idle < PATIENCE:
        residual = np.where(wanted, mass * np.clip(x, 0, caps) + soft_sums(x) - goal, 0)
        off = float((np.abs(residual).max(1) / np.maximum(goal.sum(1), 1)).max(initial=0))
        idle = 0 if off < least * 0.99 else idle + 1
        if off < least:
            best, least = x, off
        if off <= CLOSE:
            break
        x = np.where(wanted, np.rint(np.clip(x - residual / scale, -caps, 2 * caps) * RATE) / RATE, 0)
    if least > 1e-3:
        warnings.warn(f"mixing rates end {least:.2%} of a mix off their targets: the caps allow no better", stacklevel=2)
    return mixes, best, caps, wanted, least


def _expand(mixes: list[str], names: list[str], x: np.ndarray, caps: np.ndarray, wanted: np.ndarray):
    """Documents without a source to rates by mix, under their likeliest source."""
    schema = pa.schema([("mix_name", pa.string()), ("source", pa.string()), *[(c, pa.int64()) for c in (*IDENTITY, "n_tokens")], ("rate", pa.float64()), ("cap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rate, best = _soft_rates(b.column(4), b.column(5), x, caps, wanted)
            doc, mix = np.nonzero(rate)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(mixes, object)[mix], pa.string()), pa.array(np.array(names, object)[best[doc]], pa.string()), *[b.column(k).take(take) for k in range(4)],
                pa.array(rate[doc, mix]), pa.array(caps[mix, best[doc]].astype(np.int64)),
            ], schema=schema)

    return run


def rated(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None) -> DataFrame:
    """(mix_name, source, doc_id, text_hash, copy_no, n_tokens, rate, cap) of every document with a
    positive rate, by mix."""
    targets = merged_targets(mix_targets)
    known, soft, names = soft_members(documents, targets, tokenizer)
    goal = goals(targets, known, total_tokens)
    rate = goal.select(*_KEYS, "cap", F.least(F.col("goal") / F.col("mass"), F.col("cap")).alias("rate"))
    extra = None
    if names:
        rows = goal.filter(F.col("source").isin(names)).collect()  # at most the sample's sources, by mix
        mixes, x, caps, wanted, _ = fit_rates(soft, rows, names)
        if rows:
            fitted = [(m, s, float(np.clip(x[i, k], 0, caps[i, k]))) for i, m in enumerate(mixes) for k, s in enumerate(names) if wanted[i, k]]
            table = documents.sparkSession.createDataFrame(fitted, "mix_name string, source string, fitted double")
            rate = rate.join(F.broadcast(table), _KEYS, "left").select(*_KEYS, "cap", F.coalesce("fitted", "rate").alias("rate"))
            ddl = "mix_name string, source string, " + ", ".join(f"{c} bigint" for c in (*IDENTITY, "n_tokens")) + ", rate double, cap bigint"
            extra = soft.select(*IDENTITY, "n_tokens", "classes", "units").mapInArrow(_expand(mixes, names, x, caps, wanted), ddl)
    per = rate.filter("rate > 0").groupBy("source").agg(F.collect_list(F.struct("mix_name", "rate", "cap")).alias("mixes"))  # a row per target
    out = known.join(broadcast_if_bounded(per), "source").select("source", *IDENTITY, "n_tokens", F.explode("mixes").alias("m"))
    out = out.select("m.mix_name", "source", *IDENTITY, "n_tokens", "m.rate", "m.cap")
    return out if extra is None else out.unionByName(extra)


def _in_order(tokens: np.ndarray, more: np.ndarray, left: int) -> int:
    """Mark, in their order, the unmarked documents that still fit; returns what is left."""
    open_ = np.flatnonzero(~more)
    fits = np.cumsum(tokens[open_]) <= left
    first = int(fits.sum())
    more[open_[:first]] = True
    left -= int(tokens[open_[:first]].sum())
    rest = open_[first:]
    for k in rest[tokens[rest] <= left]:
        if tokens[k] <= left:
            more[k], left = True, left - int(tokens[k])
    return left


def choose(tokens: np.ndarray, left: int, slack: int) -> tuple[np.ndarray, int]:
    """Which documents (given in hash order) get the copy more, and what is left. If more than
    the slack is left, a document that did not fit takes the place of the last ones that did,
    whenever that leaves less: so a few long documents are not shut out by short ones."""
    more = np.zeros(len(tokens), bool)
    left = _in_order(tokens, more, left)
    waiting = np.flatnonzero(~more)
    _, firsts = np.unique(tokens[waiting], return_index=True)
    for b in waiting[firsts]:
        if left <= slack:
            break
        taken = np.flatnonzero(more)[::-1]
        freed = np.cumsum(tokens[taken])
        k = int(np.searchsorted(freed, tokens[b] - left))
        if more[b] or k == len(taken):
            continue
        trial = more.copy()
        trial[taken[: k + 1]], trial[b] = False, True
        room = _in_order(tokens, trial, left + int(freed[k]) - int(tokens[b]))
        if room < left:
            more, left = trial, room
    return more, left


def _fill(table: pa.Table) -> pa.Table:
    """A source's cells, in hash order: one copy more for the documents chosen."""
    table = table.sort_by([(c, "ascending") for c in ("draw", *IDENTITY)])
    more, left = choose(table.column("n_tokens").to_numpy(), int(table.column("left")[0].as_py()), int(table.column("slack")[0].as_py()))
    table = table.drop_columns(["slack"])
    return table.set_column(table.column_names.index("left"), "left", pa.array(np.full(len(table), left), pa.int64())).append_column("more", pa.array(more))


def whole_copies(rows: DataFrame) -> DataFrame:
    """rows (see ``rated``) with ``copies``: rates as whole numbers of copies whose tokens add up,
    in each source of a mix, to those of the rates as closely as the documents allow."""
    whole = F.floor(F.col("rate") + 1e-9)
    rows = rows.withColumn("whole", whole.cast("bigint")).withColumn("part", F.when(F.col("whole") < F.col("cap"), F.rint((F.col("rate") - F.col("whole")) * PART)).otherwise(0).cast("bigint"))
    draw = F.shiftright(F.xxhash64("mix_name", *IDENTITY), 1).bitwiseAND((1 << 31) - 1)
    rows, _ = materialize(rows.drop("rate").withColumn("draw", draw), "rates")
    wanted = F.floor(F.sum((F.col("n_tokens") * F.col("part")).cast("decimal(38,0)")) / PART).cast("bigint")
    sources = rows.filter("part > 0").groupBy(*_KEYS).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("bigint").alias("cells"), wanted.alias("wanted"))
    sources, _ = materialize(sources, "sources")
    cell = F.shiftright(F.col("draw") * F.col("cells"), 31).alias("cell")
    some = rows.filter("part > 0").join(broadcast_if_bounded(sources), _KEYS).withColumn("cell", cell)
    sums = some.groupBy(*_KEYS, "cell").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*_KEYS).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).join(broadcast_if_bounded(sources), _KEYS)
    cuts = over.filter("upto > wanted").groupBy(*_KEYS).agg(F.min("cell").alias("first"), (F.min_by("wanted", "cell") - F.min_by(F.col("upto") - F.col("tokens"), "cell")).alias("left"))
    cuts, _ = materialize(cuts.join(sources, _KEYS).select(*_KEYS, "first", F.col("first").alias("last"), "left", "wanted", "cells"), "cuts")
    columns = [*_KEYS, *IDENTITY, "n_tokens", "whole", "draw", "left"]
    slack = F.floor(F.col("wanted") * OPEN_SHARE).cast("bigint").alias("slack")
    ddl = "mix_name string, source string, " + ", ".join(f"{c} bigint" for c in columns[2:]) + ", more boolean"
    while True:
        opened = some.drop("wanted", "cells").join(broadcast_if_bounded(cuts.select(*_KEYS, "first", "last", "left", slack)), _KEYS).filter("cell between first and last")
        filled, _ = materialize(opened.select(*columns, "slack").groupBy(*_KEYS).applyInArrow(_fill, ddl), "filled")
        ends = filled.groupBy(*_KEYS).agg(F.min("left").alias("open"))
        again = (F.col("open") > F.floor(F.col("wanted") * OPEN_SHARE)) & (F.col("last") < F.col("cells") - 1)
        state = cuts.join(ends, _KEYS).withColumn("again", again)
        if not state.filter("again").limit(1).count():
            break
        further = F.least(F.col("cells") - 1, F.col("last") + (F.col("last") - F.col("first") + 1))
        cuts, _ = materialize(state.select(*_KEYS, "first", F.when(F.col("again"), further).otherwise(F.col("last")).alias("last"), "left", "wanted", "cells"), "cuts")
    lone = some.join(broadcast_if_bounded(cuts.select(*_KEYS, "first", "last")), _KEYS, "left").filter("first is null or cell not between first and last")
    lone = lone.withColumn("copies", F.col("whole") + F.coalesce((F.col("cell") < F.col("first")), F.lit(True)).cast("bigint"))
    out = [*_KEYS, *IDENTITY, "copies", "n_tokens"]
    counted = filled.withColumn("copies", F.col("whole") + F.col("more").cast("bigint"))
    return rows.filter("part = 0").withColumn("copies", F.col("whole")).select(*out).unionByName(lone.select(*out)).unionByName(counted.select(*out)).filter("copies > 0")


def select(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None) -> DataFrame:
    """(mix_name, source, doc_id, text_hash, copy_no, copies, n_tokens): the documents taken, and how
    often each."""
    return whole_copies(rated(documents, mix_targets, tokenizer, total_tokens))


def shares(selected: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per mix and source: target share, tokens and share reached, documents, most copies."""
    target = (
        mix_targets.filter("mix_name is not null and source is not null")
        .groupBy("mix_name", source_key(F.col("source")).alias("source"))
        .agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"))
    )
    sums = target.groupBy("mix_name").agg(F.sum("weight").alias("all"))
    target = target.join(broadcast_if_bounded(sums), "mix_name").select("mix_name", "source", F.round(F.col("weight") / F.col("all"), 6).alias("target_share"))
    got = selected.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    out = target.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    return out.select("mix_name", "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))


def invariants(selected: DataFrame, documents: DataFrame, mix_targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(mix_name, source, due_share, reached, capped) of the sources that can give tokens: the share
    due once sources without documents are left out, whether it is reached within the tolerance (or
    the length of the source's longest document taken, as none is split), and whether no document
    is taken more often than its cap."""
    targets = merged_targets(mix_targets).filter("cap > 0")
    there = documents.filter(F.length("text") > 0).select(source_key(F.col("source")).alias("source")).distinct()
    due = targets.join(there, "source").withColumn("due_share", F.col("weight") / F.sum("weight").over(Window.partitionBy("mix_name")))
    got = selected.groupBy(*_KEYS).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most"), F.max("n_tokens").alias("longest"))
    got = got.withColumn("total", F.sum("tokens").over(Window.partitionBy("mix_name")))
    both = due.join(got, _KEYS, "full_outer")
    off = F.abs(F.col("tokens") - F.col("due_share") * F.col("total"))
    return both.select(*_KEYS, F.round("due_share", 6).alias("due_share"), F.coalesce(off <= F.greatest(F.col("total") * tolerance, F.col("longest")), F.lit(False)).alias("reached"), F.coalesce(F.col("most") <= F.col("cap"), F.lit(False)).alias("capped"))


def hide_sources(documents: DataFrame, one_in: int = 5) -> DataFrame:
    """documents with the source of one in ``one_in``, by a hash of the id, taken away (and kept as
    true_source), to see what the classifier makes of them. No document is left out."""
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0
    return documents.withColumn("true_source", source_key(F.col("source"))).withColumn("source", F.when(~hidden, F.col("source")))


def true_shares(selected: DataFrame, documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``shares`` of a selection by the sources that the documents (with true_source) really have."""
    true = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "true_source").groupBy("doc_id", "text_hash").agg(F.min("true_source").alias("true_source"))
    return shares(selected.drop("source").join(true, ["doc_id", "text_hash"]).withColumnRenamed("true_source", "source"), mix_targets)
