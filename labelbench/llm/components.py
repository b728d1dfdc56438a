"""Connected components of a large edge list, by contraction on Spark.

Each round every node takes its smallest neighbour as parent, the parent's parent after that
(pointer jumping), and the edges are rewritten between parents; loops and repeats go.  A node's
label follows its parents.  The edge list shrinks until nothing is left, after a number of
rounds that grows with the logarithm of the longest chain.  Minima and the removal of repeats
are combined before they are shuffled, so a hub costs each task one row; the tables between rounds
are written to the shared checkpoint folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage


def _parents(edges: DataFrame) -> DataFrame:
    """(node, parent): the smallest of the node and its neighbours, followed twice."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
    first = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent"))
    for _ in range(2):
        above = first.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        first = first.join(above, "parent").select("node", F.col("up").alias("parent"))
    return first


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of long ids, both non-null);
    component is the smallest id that can be reached, the node's own included.  No edges: no rows."""
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut_lineage(left)
    labels = None
    while not left.isEmpty():
        parents = cut_lineage(_parents(left))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(a, "a").join(b, "b").where("pa <> pb")
        left = cut_lineage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        labels = cut_lineage(labels)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
