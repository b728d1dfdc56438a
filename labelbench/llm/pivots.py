"""Embedding near-duplicates: a pivot-permutation index, then exact cosines.

*Index.*  Up to 64 pivots are picked from a bounded sample, each as far as possible from those before
it.  A vector is described by its ``nearest`` pivots in order; every choice of ``shared`` of
them is an inverted list, and the vectors of one list have at least that many pivots in common.  All
vectors are indexed; only the pivots come from a sample.  Recall depends on how the vectors lie (those
that share a mean direction need more lists), so it is measured on the sample, against all its links and
against planted pairs close above the threshold, and ``nearest`` grows until it reaches ``RECALL``; where
``WIDEST`` falls short, the vectors of that length are all compared.

*Verification.*  The members of a list meet in cells of at most about ``cell`` x ``cell`` vectors, so a
list of any size is spread over tasks and no task holds more than two cell sides.  A pair that shares
several lists is counted in the one of its lowest common pivots.  Cosines are taken in double
precision.  A cell returns sums and a spanning forest of its links, never the pairs.

Equal vectors of one label are merged first and count with their number; a merged vector has a number of its own, since
rows that share a vec_id may hold different vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do vectors without label or id, or of different lengths; rows that share a
vec_id are vectors of their own, linked only if they are alike, and repeated rows are one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import batch, cut_lineage

#: Pivots, the sample they are picked from, nearest pivots of a vector, and those that a list stands for.
PIVOTS, SAMPLE, NEAREST, SHARED = 64, 2048, 5, 3
#: Recall that the index must reach on the sample, the most nearest pivots, and links of the sample that count as enough.
RECALL, WIDEST, ENOUGH = 0.92, 12, 100
CELL = 1024

_KEYS = pa.schema([("rep", pa.int64()), ("label", pa.string()), ("mask", pa.int64()), ("key", pa.int64())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array):
    """(positions, matrix) for each length among the vectors of a column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x`` (unit vectors), each with the smallest largest cosine to those before it."""
    chosen, worst = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        k = int(np.argmin(worst))
        if worst[k] > 1 - 1e-9:
            break
        chosen.append(k)
        worst = np.maximum(worst, x @ x[k])
    return x[chosen]


def masks(x: np.ndarray, pivots: np.ndarray | None, nearest: int = NEAREST) -> np.ndarray:
    """The nearest pivots of unit vectors, one bit each; without pivots all vectors are alike."""
    if pivots is None:
        return np.zeros(len(x), np.uint64)
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest]
    return np.bitwise_or.reduce(np.uint64(1) << near.astype(np.uint64), axis=1)


def planted(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of ``x``, and for each one another with a cosine from ``least`` to half way to 1."""
    r = np.random.default_rng(0)
    x = np.tile(x, (-(-SAMPLE // len(x)), 1))[:max(SAMPLE, len(x))]
    away = r.normal(size=x.shape)
    away = _unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    cos = r.uniform(least, (least + 1) / 2, (len(x), 1))
    return x, cos * x + np.sqrt(np.maximum(1 - cos * cos, 0)) * away


def widen(x: np.ndarray, pivots: np.ndarray, least: float, nearest: int = NEAREST, shared: int = SHARED) -> int | None:
    """The smallest number of nearest pivots, from ``nearest`` on, whose lists reach the recall on unit vectors ``x``."""
    if x.shape[1] < 2 or len(pivots) <= nearest:
        return nearest  # all vectors have the same pivots
    a, b = planted(x, least)
    linked = np.triu(x @ x.T >= least, 1)
    for n in range(nearest, min(max(WIDEST, nearest), len(pivots)) + 1):
        recall = (np.bitwise_count(masks(a, pivots, n) & masks(b, pivots, n)) >= shared).mean()
        if recall >= RECALL and linked.sum() >= ENOUGH:
            own = masks(x, pivots, n)
            recall = (np.bitwise_count(own[:, None] & own) >= shared)[linked].mean()
        if recall >= RECALL:
            return n
    return None


def lists(mask: int, shared: int = SHARED) -> list[int]:
    """The inverted lists of a vector: every choice of ``shared`` of its pivots."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    return [sum(c) for c in itertools.combinations(bits, min(shared, len(bits)))] or [0]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix."""
    todo, out = linked.any(axis=1), []
    for seed in np.flatnonzero(todo):
        if not todo[seed]:
            continue
        todo[seed], front = False, [seed]
        while front:
            u = front.pop()
            for v in np.flatnonzero(linked[u] & todo).tolist():
                todo[v] = False
                out.append((u, v))
                front.append(v)
    return out


def _verify(reps, many, mask, side, x, key: int, both: bool, least: float) -> list[tuple]:
    """Rows (a, b, links) of a cell: links of each vector with b = a, and edges of a forest."""
    unit = _unit(x)
    linked = unit @ unit.T >= least
    common = mask[:, None] & mask
    upto = np.uint64((1 << key.bit_length()) - 1)
    linked &= (common & upto) == np.uint64(key)  # the list of the lowest common pivots
    np.fill_diagonal(linked, False)
    if both:
        linked &= side[:, None] != side
    sums = linked @ many
    there = np.flatnonzero(linked.any(axis=1)).tolist()
    return [(int(reps[i]), int(reps[i]), int(sums[i])) for i in there] + [(int(reps[u]), int(reps[v]), 0) for u, v in _forest(linked)]


def _cells(rows: DataFrame, least: float) -> DataFrame:
    """Streams sorted cells; a cell is held whole, which is bounded."""

    def run(batches):
        held, at = [], None

        def flush():
            table = pa.Table.from_batches(held)
            if table.num_rows < 2 or (at[3] != at[4] and len(table.column("side").unique()) < 2):
                return None
            out = []
            cols = {n: table.column(n).to_numpy() for n in ("rep", "m", "mask", "side")}
            for where, x in _by_length(table.column("embedding")):
                out += _verify(cols["rep"][where], cols["m"][where], cols["mask"][where].view(np.uint64), cols["side"][where], x,
                               at[2] & (1 << 64) - 1, at[3] != at[4], least)
            return batch(_FOUND, list(zip(*out))) if out else None

        for rows in batches:
            names = ("label", "dim", "key", "ci", "cj")
            keys = list(zip(*(rows.column(n).to_pylist() for n in names)))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != at:
                        if held and (out := flush()) is not None:
                            yield out
                        held, at = [], keys[start]
                    held.append(rows.slice(start, i - start))
                    start = i
        if held and (out := flush()) is not None:
            yield out

    order = ("label", "dim", "key", "ci", "cj")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, links long")


def _pivots(classes: DataFrame, least: float, nearest: int, shared: int) -> dict:
    """{length of the vectors: (pivots, number of nearest ones)}, from the vectors with the smallest hashes of their ids."""
    sample = classes.select("first", "label", "embedding").orderBy(F.xxhash64("first"), "first", "label", "embedding").limit(SAMPLE).collect()
    by: dict = {}
    for r in sample:
        by.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for n, v in by.items():
        x = _unit(np.array(v, np.float64))
        p = farthest_first(x, PIVOTS)
        wide = widen(x, p, least, nearest, shared)
        out[n] = (p, wide) if wide else (None, nearest)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.93, nearest: int = NEAREST, shared: int = SHARED, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.coalesce(usable, F.lit(False)))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("m"))
    classes = cut_lineage(classes.withColumns({"dim": F.size("embedding"), "rep": F.monotonically_increasing_id()}))
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes, least, nearest, shared))  # 64 vectors for each length in the sample

    def index(batches):
        for rows in batches:
            out = []
            reps, labels = rows.column("rep").to_pylist(), rows.column("label").to_pylist()
            for where, x in _by_length(rows.column("embedding")):
                found = masks(_unit(x), *pivots.value.get(x.shape[1], (None, nearest)))
                for i, m in zip(where.tolist(), found.tolist()):
                    signed = m - (1 << 64) if m >> 63 else m
                    out += [(reps[i], labels[i], signed, k - (1 << 64) if k >> 63 else k) for k in lists(m, shared)]
            if out:
                yield batch(_KEYS, list(zip(*out)))

    listed = cut_lineage(classes.select("rep", "label", "embedding").mapInArrow(index, "rep long, label string, mask long, key long"))
    counts = listed.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")
    placed = listed.join(counts, ["label", "key"]).withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("ci", F.least("side", "other")).withColumn("cj", F.greatest("side", "other"))
    filled = placed.select("rep", "label", "mask", "key", "side", "ci", "cj").join(classes.drop("label"), "rep")
    found = cut_lineage(_cells(filled.select("label", "dim", "key", "ci", "cj", "rep", "m", "mask", "side", "embedding"), least))

    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    groups = components(found.where("a <> b").select("a", "b"))
    smallest = groups.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    groups = groups.join(smallest, "component").select("node", "component_id")
    known = classes.join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
