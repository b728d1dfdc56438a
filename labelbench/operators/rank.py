"""Exact row numbers inside very large groups without one giant window task.

``row_number() over (partition by label order by key)`` puts every row of a
label into a single task; with two or three labels that is a third of the data
per task.  The two-phase form splits each group into buckets by a prefix of
the sort key (the prefix order agrees with the key order), counts per
(group, bucket), turns the small count table into running offsets, and ranks
inside (group, bucket) only.  The offsets join back on (group, bucket); Spark's
AQE turns that join into a broadcast once it has measured the count table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_phase_row_number(df: DataFrame, partition_cols: list[str], order_col: str,
                         bucket: Column, out: str = "rn",
                         tie_cols: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number of each row inside ``partition_cols``
    ordered by ``order_col`` (then ``tie_cols``); with ``total``, also the
    group's row count (from the same small table, no extra pass).

    ``bucket`` must be order-preserving: ``bucket(a) < bucket(b)`` implies
    ``a < b`` for the sort key (e.g. a fixed-length prefix of a hex hash).
    """
    tie_cols = tie_cols or []
    b = "__bucket"
    keyed = df.withColumn(b, bucket)
    counts = keyed.groupBy(*partition_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(*partition_cols).orderBy(b).rowsBetween(
        Window.unboundedPreceding, -1)
    extra = [F.sum("__n").over(Window.partitionBy(*partition_cols)).alias(total)] if total else []
    offsets = counts.select(*partition_cols, b,
                            F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"), *extra)
    # a NULL group is a group: window and join keys are (is-null, value) pairs,
    # so the equi-join keeps its rows and the rows are shuffled only once
    keys = null_safe_keys(df, partition_cols)
    ranked = with_keys(keyed, keys)
    w = Window.partitionBy(*[k for k, _ in keys], b).orderBy(order_col, *tie_cols)
    ranked = ranked.withColumn("__rn_local", F.row_number().over(w))
    offs = with_keys(offsets, keys).drop(*partition_cols)
    names = [k for k, _ in keys]
    return (ranked.join(offs, [*names, b], "inner")
            .withColumn(out, (F.col("__off") + F.col("__rn_local")).cast("long"))
            .drop(b, "__off", "__rn_local", *names))


def null_safe_keys(df: DataFrame, cols: list[str]) -> list[tuple[str, Column]]:
    """(name, expression) pairs that stand for ``cols`` in equi-joins with NULL
    matching NULL: an is-null flag and the value with NULL replaced."""
    out = []
    for i, c in enumerate(cols):
        t = df.schema[c].dataType
        out.append((f"__kn{i}", F.col(c).isNull()))
        out.append((f"__kv{i}", F.coalesce(F.col(c), F.lit(0).cast(t))))
    return out


def with_keys(df: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    for name, expr in keys:
        df = df.withColumn(name, expr)
    return df


def hex_bucket(key_col: str, digits: int = 4) -> Column:
    """Order-preserving bucket of a lowercase hex hash: its first ``digits`` chars
    (4 digits = 65,536 buckets per group)."""
    return F.substring(F.col(key_col), 1, digits)
