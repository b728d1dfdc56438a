"""Class and token profiles of a labelled table.

Input is one DataFrame with ``src``, ``label``, ``split`` (and ``ord``).  All
aggregates are two-stage (partial per task, final per key); only class-, split-
or cell-size results ever reach a window without partition keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count, tokens
from .splits import first_rows_per_split

SPLITS = ("train", "valid", "test")


def class_distribution(df: DataFrame, label_col: str = "label", split_col: str = "split",
                       splits=SPLITS, total_label: str = "Total") -> DataFrame:
    """A1: label x split counts; an empty cell is NULL; a ``Total`` row sums the
    columns ignoring NULL.  Sorted by the split counts descending, NULL last.  A row
    whose split is NULL or not one of ``splits`` is an error."""
    known = F.when(F.col(split_col).isin(list(splits)), F.col(split_col)).otherwise(F.raise_error(
        F.concat(F.lit("unknown split: "), F.coalesce(F.col(split_col), F.lit("NULL")))))
    cells = (df.groupBy(F.col(label_col).cast("string").alias("label"), known.alias(split_col))
             .agg(F.count(F.lit(1)).alias("n")))
    wide = cells.groupBy("label").pivot(split_col, list(splits)).agg(F.first("n"))
    total = wide.agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in splits]) \
                .select(F.lit(total_label).alias("label"), *splits)
    out = wide.select("label", *[F.col(s).cast("long").alias(s) for s in splits]) \
              .withColumn("is_total", F.lit(False)) \
              .unionByName(total.withColumn("is_total", F.lit(True)))
    return out.orderBy("is_total", *[F.desc_nulls_last(s) for s in splits], "label").drop("is_total")


def label_counts(df: DataFrame, split: str | None = None, label_col: str = "label",
                 split_col: str = "split") -> DataFrame:
    """A2: rows per label (in one split when ``split`` is given)."""
    if split is not None:
        df = df.where(F.col(split_col) == split)
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "label", inverse: bool = False) -> DataFrame:
    """A3: weight = class count / rows, in code order (frequency, as the original
    does).  ``inverse=True`` gives rows / class count instead."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    total = F.sum("n").over(every)
    w = (total / F.col("n")) if inverse else (F.col("n") / total)
    return (counts.withColumn("weight", w.cast("double"))
            .withColumn("code", (F.row_number().over(Window.orderBy(label_col)) - 1).cast("int"))
            .select(label_col, "code", "n", "weight"))


def _describe(value_col: str):
    v = F.col(value_col)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).cast("double").alias("min"), q.alias("__q"), F.max(v).cast("double").alias("max")]


def _describe_finish(df: DataFrame, keys: list[str], rounded: bool) -> DataFrame:
    cols = [F.col("count").cast("long").alias("count"), F.col("mean"), F.col("std"), F.col("min"),
            F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"),
            F.col("max")]
    out = df.select(*keys, *cols)
    if rounded:
        out = out.select(*keys, "count", *[F.bround(c, 0).alias(c) for c in
                                          ("mean", "std", "min", "p25", "p50", "p75", "max")])
    return out


def with_token_count(df: DataFrame, src_col: str = "src", tokenizer=None,
                     out: str = "n_tokens") -> DataFrame:
    """X9 as a column on the table (computed once, reused by A4-A6)."""
    return df.withColumn(out, token_count(src_col, tokenizer))


def describe_tokens(df: DataFrame, value_col: str = "n_tokens", split_col: str = "split",
                    rounded: bool = True) -> DataFrame:
    """A4: per split count, mean, sample std, min, 25/50/75 % (linear
    interpolation, exact), max; rounded half-even to integers.

    ``percentile`` keeps a value -> frequency map per group, so for token
    counts its state is bounded by the number of distinct lengths."""
    agg = df.groupBy(split_col).agg(*_describe(value_col))
    return _describe_finish(agg, [split_col], rounded)


def describe_columns(df: DataFrame, cols: list[str], split_col: str = "split", rounded: bool = True) -> DataFrame:
    """A4 for several columns at once, long form ``(split, column, count, ...)``.

    The original describes every numeric column of its frame: the token count
    and, when labels are integers, the label too."""
    numeric = [c for c in cols if df.schema[c].dataType.typeName() in
               ("integer", "long", "short", "byte", "double", "float", "decimal")]
    long = df.select(split_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("__v")) for c in numeric])).alias("r")) \
        .select(split_col, "r.column", "r.__v")
    agg = long.groupBy(split_col, "column").agg(*_describe("__v"))
    return _describe_finish(agg, [split_col, "column"], rounded)


def describe_tokens_by_class(df: DataFrame, value_col: str = "n_tokens", split_col: str = "split",
                             label_col: str = "label", rounded: bool = True) -> DataFrame:
    """A5: as A4 per (split, label)."""
    agg = df.groupBy(split_col, label_col).agg(*_describe(value_col))
    return _describe_finish(agg, [split_col, label_col], rounded)


STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_tokens_by_class_wide(df: DataFrame, value_col: str = "n_tokens", split_col: str = "split",
                                  label_col: str = "label", splits=SPLITS, rounded: bool = True) -> DataFrame:
    """A5 in the original's shape: one row per label, the splits' statistics
    side by side (``train_count``, ``train_mean``, ...), ordered by the train
    count descending.  One pivot over the long result (J7), no repeated joins."""
    long = describe_tokens_by_class(df, value_col, split_col, label_col, rounded)
    wide = long.groupBy(label_col).pivot(split_col, list(splits)).agg(*[F.first(c).alias(c) for c in STATS])
    return wide.orderBy(F.desc_nulls_last(f"{splits[0]}_count"), label_col)


def dataset_stats(df: DataFrame, value_col: str = "n_tokens", split_col: str = "split") -> DataFrame:
    """Rows, mean, max, min and **population** std of the token count per split."""
    v = F.col(value_col)
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(v).alias("num_tokens_avg"),
        F.max(v).alias("num_tokens_max"), F.min(v).alias("num_tokens_min"),
        F.stddev_pop(v).alias("num_tokens_std"))


def unique_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Sorted distinct labels over all splits."""
    return df.select(label_col).distinct().orderBy(label_col)


def num_classes(df: DataFrame, label_col: str = "label", split_col: str = "split",
                split: str = "train") -> DataFrame:
    """Number of distinct labels in the train split (one row)."""
    return (df.where(F.col(split_col) == split)
            .agg(F.count_distinct(label_col).cast("long").alias("num_classes")))


def label_set_check(df: DataFrame, label_col: str = "label", split_col: str = "split",
                    splits=SPLITS, raise_on_violation: bool = False) -> DataFrame:
    """Labels not present in every split (empty result = the check passes)."""
    per = (df.where(F.col(split_col).isin(list(splits)))
           .groupBy(label_col).agg(F.collect_set(split_col).alias("__present")))
    expected = F.array(*[F.lit(s) for s in splits])
    out = (per.withColumn("n_splits", F.size("__present").cast("int"))
           .where(F.col("n_splits") < len(splits))
           .withColumn("missing", F.array_join(F.array_sort(F.array_except(expected, F.col("__present"))), ","))
           .drop("__present"))
    if raise_on_violation:
        out = out.withColumn("missing", F.raise_error(F.concat(
            F.lit("label sets of the splits differ: "), F.col(label_col).cast("string"))))
    return out


def split_overlap(df: DataFrame, src_col: str = "src", split_col: str = "split",
                  base: str = "train", others=("valid", "test")) -> DataFrame:
    """Number of distinct texts shared by ``base`` and each other split.

    Texts are keyed by sha2-256; one group-by on the key with partial
    aggregation (a hot duplicated text collapses map-side), then one tiny sum."""
    flags = (df.where(F.col(split_col).isin(base, *others))
             .groupBy(F.sha2(F.col(src_col), 256).alias("h"))
             .agg(*[F.max(F.when(F.col(split_col) == s, 1).otherwise(0)).alias(s)
                    for s in (base, *others)]))
    sums = flags.agg(*[F.sum(F.col(base) * F.col(o)).cast("long").alias(o) for o in others])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(o).alias("split"), F.col(o).alias("overlap")) for o in others])).alias("r")) \
        .select("r.split", "r.overlap")


def intersect_texts(df: DataFrame, a: str, b: str, src_col: str = "src",
                    split_col: str = "split") -> DataFrame:
    """O3: distinct texts present in both splits.

    Grouped by a sha2-256 key with one flag per side: each distinct text is
    shuffled once, after map-side de-duplication (a plain ``intersect`` shuffles
    the texts of both sides in full)."""
    g = (df.where(F.col(split_col).isin(a, b))
         .groupBy(F.sha2(F.col(src_col), 256).alias("__h"))
         .agg(F.first(src_col).alias(src_col),
              F.max(F.when(F.col(split_col) == a, 1).otherwise(0)).alias("__a"),
              F.max(F.when(F.col(split_col) == b, 1).otherwise(0)).alias("__b")))
    return g.where((F.col("__a") == 1) & (F.col("__b") == 1)).select(src_col)


def union_labels(df: DataFrame, label_col: str = "label", split_col: str = "split",
                 splits=SPLITS) -> DataFrame:
    """Union of the label sets of the splits (distinct) - in one pass: the
    distinct labels of the rows of those splits."""
    return df.where(F.col(split_col).isin(list(splits))).select(label_col).distinct()


def first_examples(df: DataFrame, k: int = 3, src_col: str = "src", split_col: str = "split",
                   ord_col: str = "ord", strict: bool = False) -> DataFrame:
    """The first ``k`` examples of each split with their tokens and count.
    ``strict=True`` raises when a split has fewer than ``k`` rows (the original
    indexes the first three and fails)."""
    head = first_rows_per_split(df, k, split_col, ord_col)
    out = head.select(split_col, ord_col, src_col,
                      F.array_join(tokens(src_col), " ").alias("tokens"),
                      token_count(src_col).alias("n_tokens"))
    if strict:  # at most k rows per split here, so the window is tiny
        n = F.count(F.lit(1)).over(Window.partitionBy(split_col))
        out = out.withColumn("n_tokens", F.when(n < k, F.raise_error(
            F.concat(F.lit(f"fewer than {k} examples in split "), F.col(split_col))))
            .otherwise(F.col("n_tokens")).cast("int"))
    return out


def align_columns(long_df: DataFrame, key_cols: list[str], column_col: str, values: list,
                  value_col: str) -> DataFrame:
    """Outer alignment of per-split (or per-dataset) tables side by side:
    one pivot on the long table instead of repeated full joins."""
    return long_df.groupBy(*key_cols).pivot(column_col, values).agg(F.first(value_col))
