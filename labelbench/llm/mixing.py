"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of ``block`` documents.  With weight w, block j may start at
slot floor(j / w) and must be placed before slot ceil((j + 1) / w); among the released blocks the one
with the earliest deadline gets the slot.  The weights are exact fractions (of 2^-64 of all slots at least), the schedule
runs over the whole mix, and every deadline is met, so at every slot each source is less than one block away from its weight.

The schedule is a list of slots that the driver makes and the tasks look up.  Its length is bounded: where the mix would
last more than ``MOST_SLOTS`` slots, the blocks are made larger instead, so the list does not grow with
the input (a source with less than 1 / ``MOST_SLOTS`` of the weight takes one slot for itself, and may need more).

A mix lasts until each source has been read through at least once; a source with more
weight than documents starts again (its epoch counts up), so no document is lost and every
prefix of the mix holds the weights.  Without given weights a source weighs its number of documents
to the power of ``temperature``.

A document's number within its source is its position in the task that reads it, plus the documents of
that source in the tasks before.  The numbered rows are written once, and both the counts and the rows
come from that table: an input that is read again in other tasks (after the loss of an executor, or at a
later action) changes nothing.  No shuffle is needed to number a source, however large it is.

Defined cases: a null source is a source of its own; sources without weight are an error where
weights are given; repeated rows are separate documents; null text and null ids are mixed like any
other; the last block of a source may be shorter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .tables import cut_lineage

#: Documents in a block at least; exponent of a source's size where no weights are given; slots of a mix, and sources, at most.
BLOCK, TEMPERATURE, MOST_SLOTS, MOST_SOURCES = 64, 0.7, 1 << 20, 10_000
#: Weights are counted in 1 / UNIT of all slots.
UNIT = 1 << 64


def shares(weights: dict) -> list[Fraction]:
    """The weights in their order, exactly, with sum UNIT and each 1 at least."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = [Fraction(w) for w in weights.values()]
    total = sum(exact)
    out = [max(Fraction(1), w / total * UNIT) for w in exact]
    out[max(range(len(out)), key=out.__getitem__)] += UNIT - sum(out)
    return out


def window(share: Fraction, block: int) -> tuple[int, int]:
    """The slot from which a block may be placed, and the one before which it must be."""
    part, whole = share.numerator, share.denominator * UNIT
    return block * whole // part, -(-(block + 1) * whole // part)


def block_size(sizes: list[int], share: list[Fraction], block: int, most: int) -> int:
    """The least block, from ``block`` documents on, with which all sources are read in about ``most`` slots."""
    return max(block, *(-(-n * UNIT // (s * most)) for n, s in zip(sizes, share)))


def schedule(share: list[Fraction], blocks: list[int]) -> list[int]:
    """The source of every slot, by earliest deadline first, until each source has placed its blocks; ties go by place."""
    waiting = [(0, i, 0) for i in range(len(share))]  # by release
    ready: list[tuple] = []
    out: list[int] = []
    missing = sum(n > 0 for n in blocks)
    while missing:
        while waiting and waiting[0][0] <= len(out):
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(share[i], j)[1], i, j))
        _, i, j = heapq.heappop(ready)
        out.append(i)
        missing -= j + 1 == blocks[i]
        heapq.heappush(waiting, (window(share[i], j + 1)[0], i, j + 1))
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the task's number and the row's position among those of its source in the task.  Python sees the
    sources alone; texts and other columns stay in the JVM."""

    @F.arrow_udf("__task int, __row long")
    def at(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        task, counts = TaskContext.get().partitionId(), {}
        for sources in batches:
            rows = []
            for s in sources.to_pylist():
                k = counts.get(s, 0)
                counts[s] = k + 1
                rows.append(k)
            yield pa.StructArray.from_arrays([pa.array([task] * len(rows), pa.int32()), pa.array(rows, pa.int64())], ["__task", "__row"])

    placed = docs.withColumn("__place", at.asNondeterministic()("source"))
    return placed.withColumns({k: F.col(f"__place.{k}") for k in ("__task", "__row")}).drop("__place")


def place(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, temperature: float = TEMPERATURE, most_slots: int = MOST_SLOTS) -> DataFrame:
    """``docs`` with epoch, block (number within its source), position (within the block), slot,
    release and deadline (in slots), one row for each time that a document is read; columns of these names are replaced."""
    spark, names = docs.sparkSession, docs.columns
    source = F.col("source")
    numbered = cut_lineage(_numbered(docs))
    per_task = cut_lineage(numbered.groupBy("__task", "source").agg(F.count("*").alias("n")))
    sizes = {r.source: r.n for r in per_task.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix groups of them")
    if not sizes:
        extra = {"epoch": "int", "block": "long", "position": "long", "slot": "long", "release": "long", "deadline": "long"}
        return docs.select(*[F.col(f"`{c}`") for c in names if c not in extra], *[F.lit(None).cast(t).alias(c) for c, t in extra.items()]).where(F.lit(False))
    if weights is None:
        weights = {s: n ** temperature for s, n in sizes.items()}
    missing = [s for s in sizes if s not in weights]
    if missing:
        raise ValueError(f"no weight for source {missing[0]!r}")
    # in the order of the names, as ties go by it
    order = sorted(sizes, key=str)
    share = shares({s: weights[s] for s in order})
    block = block_size([sizes[s] for s in order], share, block, most_slots)
    blocks = [-(-sizes[s] // block) for s in order]
    source_at = np.array(schedule(share, blocks), np.int32)
    by_source = np.argsort(source_at, kind="stable")  # the slots of each source, one source behind the other
    last = np.bincount(source_at, minlength=len(order))
    begin = np.cumsum(last) - last
    listed = [(s, i, n, k) for i, (s, n, k) in enumerate(zip(order, blocks, last.tolist()))]
    kind = docs.schema["source"].dataType
    if kind == StringType():  # Arrow needs no Python workers; those that turn a list into rows are a pool of their own in each executor, and stay
        listed = pa.table([pa.array(c) for c in zip(*listed)], ["__s", "__id", "__blocks", "__last"])
    per_source = spark.createDataFrame(listed, f"__s {kind.simpleString()}, __id int, __blocks long, __last long")
    before = Window.partitionBy("source").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(F.col("source").alias("__s"), F.col("__task").alias("__of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
    # written first, so that Spark knows its size when it chooses between broadcast and shuffle
    offsets = cut_lineage(offsets)
    rows = numbered.join(offsets, source.eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__of"))).drop("__s", "__of", "__task")
    rows = rows.join(F.broadcast(per_source), source.eqNullSafe(F.col("__s"))).drop("__s").withColumn("__i", F.col("__off") + F.col("__row"))
    # a source is read again while its blocks, counted on, still have slots
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("__last") - 1) / F.col("__blocks")).cast("int"))))
    rows = rows.withColumn("__b", F.col("__epoch") * F.col("__blocks") + F.floor(F.col("__i") / block)).where(F.col("__b") < F.col("__last"))
    shared = spark.sparkContext.broadcast((by_source, begin, share))  # a number for each slot

    @F.pandas_udf("slot long, release long, deadline long")
    def slot_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        slots, begin, share = shared.value
        for ids, b in batches:
            pairs = pd.DataFrame({"id": ids, "b": b}).drop_duplicates()
            windows = {(i, j): window(share[i], j) for i, j in zip(pairs["id"].tolist(), pairs["b"].tolist())}
            found = [windows[p] for p in zip(ids.tolist(), b.tolist())]
            yield pd.DataFrame({"slot": slots[begin[ids.to_numpy()] + b.to_numpy()], "release": [w[0] for w in found], "deadline": [w[1] for w in found]}, dtype="int64")

    rows = rows.withColumn("__at", slot_of("__id", "__b"))
    own = {"epoch": F.col("__epoch"), "block": F.col("__b").cast("long"), "position": (F.col("__i") % block).cast("long"),
           "slot": F.col("__at.slot"), "release": F.col("__at.release"), "deadline": F.col("__at.deadline")}
    return rows.select(*[F.col(f"`{c}`") for c in names if c not in own], *[v.alias(c) for c, v in own.items()])


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule, again where a source is read again."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias("source" if c == "source" else f"c{i}") for i, c in enumerate(names)])
    placed = place(renamed, weights, block, temperature)
    ordered = placed.repartitionByRange("slot", "position").sortWithinPartitions("slot", "position")
    return ordered.select(*[F.col("source" if c == "source" else f"c{i}").alias(c) for i, c in enumerate(names)])
