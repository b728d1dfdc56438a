"""Writers (K1-K9).

Stored tables are never rewritten: an append, an upsert or a metric log adds a version
folder (``v=000001`` ...) that holds only what is new, and readers take all complete
versions, so a lost executor or a failed job leaves the stored rows intact.  A compacted
folder (``c=000007-000000``: what readers saw up to version 7) stands in for the versions up to its number, which
readers pass over from then on and their owner may delete.  ``compact`` writes the table that
readers see as one version elsewhere.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def write_split_jsonl(df: DataFrame, path: str, cols=("src", "label"), extra=()) -> None:
    """K1: one JSON-lines folder per split (``split=train`` ...), overwritten."""
    (df.select(*cols, *extra, "split").write.mode("overwrite").partitionBy("split")
     .option("ignoreNullFields", "false").json(path))


def write_tables(tables: dict, path: str, params: dict | None = None) -> None:
    """K2: one parquet folder per table; the parameters that went into the file
    name become columns."""
    for name, df in tables.items():
        out = df
        for k, v in (params or {}).items():
            out = out.withColumn(k, F.lit(v))
        out.write.mode("overwrite").parquet(os.path.join(path, name))


def write_predictions(files: DataFrame, path: str, key_cols=("run_id", "file"), order_col: str = "ex_id",
                      value_col: str = "pred", partitions: int | None = None) -> None:
    """K3: one label per line per (run, file), in example order.

    Range partitioning on (run, file, example) keeps the lines of a large
    run in several part files whose names follow the example order, instead of
    sending a whole run to one task."""
    n = partitions or files.sparkSession.sparkContext.defaultParallelism
    (files.repartitionByRange(n, *key_cols, order_col).sortWithinPartitions(*key_cols, order_col)
     .select(*key_cols, F.col(value_col).cast("string").alias("value"))
     .write.mode("overwrite").partitionBy(*key_cols).text(path))


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, p = _hadoop(spark, f"{folder}/_SUCCESS")
    return fs.exists(p)


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(number, -1 for a version or the attempt of a compaction, name) of every folder, also of writes that failed."""
    fs, p = _hadoop(spark, path)
    found = [re.fullmatch(r"v=(\d+)|c=(\d+)-(\d+)", st.getPath().getName()) for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(m[1] or m[2]), int(m[3] or 0) if m[2] else -1, m[0]) for m in found if m)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders that hold the stored rows: the last complete compaction and the complete versions after it."""
    out: list[str] = []
    for _, attempt, name in _folders(spark, path):
        if _complete(spark, f"{path}/{name}"):
            out = [name] if attempt >= 0 else out + [name]
    return out


def read_versions(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame | None:
    """Rows of all complete versions (or of those in ``names``) with their number ``__version``; None if there is none."""
    names = _versions(spark, path) if names is None else names
    if not names:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{path}/{n}" for n in names])
    number = F.regexp_extract("_metadata.file_path", r"/[vc]=(\d+)[-\d]*/[^/]*$", 1).cast("int")
    return rows.select("*", number.alias("__version"))


def read_appended(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows of ``append_distinct``."""
    rows = read_versions(spark, path)
    return None if rows is None else rows.drop("__version")


def read_upserted(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The stored rows of ``upsert_by_key``: each key with the values of its last version."""
    rows = read_versions(spark, path)
    if rows is None:
        return None
    values = [c for c in rows.columns if c not in (key, "__version")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), "__version").alias("__r"))
    return last.select(key, "__r.*")


def compact(table: DataFrame, path: str) -> None:
    """``table`` (what a reader of versions returned) as the first version of a new path."""
    _write_next(table, path)


def _write_next(df: DataFrame, path: str) -> str:
    # numbered past every folder, also one left by a job that died half way
    found = _folders(df.sparkSession, path)
    name = f"v={(found[-1][0] + 1 if found else 1):06d}"
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return name


def compact_versions(table: DataFrame, path: str) -> str:
    """``table`` (what a reader of ``path`` returned, with no write since) as the one folder that stands for the versions so far."""
    found = _folders(table.sparkSession, path)
    last = found[-1][0]
    name = f"c={last:06d}-{sum(n == last and k >= 0 for n, k, _ in found):06d}"
    table.write.mode("errorifexists").parquet(f"{path}/{name}")
    return name


def _row_hash(df: DataFrame):
    # by name, so that it does not depend on their order; a NULL adds nothing, so a column that a version lacks does not either
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def _index_rows(spark: SparkSession, path: str, name: str) -> None:
    """The row hashes of a version, beside it: 8 bytes a row."""
    rows = spark.read.parquet(f"{path}/{name}")
    rows.select(_row_hash(rows).alias("h")).write.mode("overwrite").parquet(f"{path}/_rows/{name}")


def versions_that_may_hold(rows: DataFrame, path: str) -> list[str]:
    """The versions where the hash of one of ``rows`` is stored, and those without hashes (of a write that failed after its
    rows, or of an older library).  It reads hashes alone.  Every version that holds one of the rows is among them."""
    spark = rows.sparkSession
    names = _versions(spark, path)
    indexed = [n for n in names if _complete(spark, f"{path}/_rows/{n}")]
    if not indexed:
        return names
    name = F.regexp_extract("_metadata.file_path", r"/_rows/([^/]+)/[^/]*$", 1).alias("name")
    stored = spark.read.parquet(*[f"{path}/_rows/{n}" for n in indexed]).select("h", name)
    hit = stored.join(rows.select(_row_hash(rows).alias("h")), "h", "left_semi").select("name").distinct()
    found = {r.name for r in hit.collect()}  # one row a version at most
    return [n for n in names if n in found or n not in indexed]


def append_distinct(new: DataFrame, path: str, compact_after: int | None = None) -> DataFrame:
    """K4: adds the rows of ``new`` that the table does not hold yet (equal in all columns, NULL
    equal to NULL); the table is created when missing.  Returns the stored rows.

    Each version keeps the hashes of its rows beside it.  The new rows' hashes are looked up there, and only versions
    that have one of them are read and compared column by column, so an append of rows that are all new reads no stored row.
    A column of another type than the stored one is an error, before anything is written.
    (64 bits a row, as many as a Bloom filter takes for one false hit in 10^13: a false hit reads a whole version, and at
    a percent any large append would read them all.)  Above ``compact_after`` folders the stored rows are written as one."""
    spark, rows = new.sparkSession, new.dropDuplicates()
    names = _versions(spark, path)
    if names:
        rows = cut_lineage(rows)  # looked up, compared and written: the same rows each time
        schema = read_versions(spark, path, names).drop("__version").schema
        for f in schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
            elif rows.schema[f.name].dataType.simpleString() != f.dataType.simpleString():  # versions of both types could not be read together
                raise TypeError(f"{f.name} is stored as {f.dataType.simpleString()}, not {rows.schema[f.name].dataType.simpleString()}")
        old = read_versions(spark, path, versions_that_may_hold(rows, path))
        if old is not None:
            old = old.drop("__version")
            for c in rows.columns:
                if c not in old.columns:
                    old = old.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
            o, n = old.alias("o"), rows.alias("n")
            same = F.lit(True)
            for c in rows.columns:
                same = same & F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
            rows = n.join(o, same, "left_anti")
    _index_rows(spark, path, _write_next(rows, path))
    if compact_after is not None and len(names) + 1 > compact_after:
        _index_rows(spark, path, compact_versions(read_appended(spark, path), path))
    return read_appended(spark, path)


def upsert_by_key(new: DataFrame, path: str, key: str, order_col: str | None = None) -> DataFrame:
    """K5: dictionary update: a key present in ``new`` takes its value (even a NULL), other stored
    keys stay.  Rows have no order, so of a key given several times in one call the one with the largest ``order_col`` is
    the last and counts; without ``order_col``, or where that ties, different values for one key are an error and equal
    ones count once.  Only the rows of ``new`` are written.  Returns the stored rows."""
    values = [c for c in new.columns if c != key]
    row = F.struct(*values)
    by = [key, order_col] if order_col else [key]
    each = new.groupBy(*by).agg(F.min(row).alias("__lo"), F.max(row).alias("__hi"))
    if order_col:
        each = each.groupBy(key).agg(F.max_by(F.struct("__lo", "__hi"), F.struct(F.lit(1), order_col)).alias("__r")).select(key, "__r.*")
    same = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__lo")).otherwise(
        F.raise_error(F.concat(F.lit("several values for the key "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).cast(each.schema["__lo"].dataType))
    once = each.select(key, same.alias("__v")).select(key, *[F.col("__v")[c].alias(c) for c in values])
    _write_next(once.select(*new.columns), path)
    return read_upserted(new.sparkSession, path, key)


def log_metrics(rows: DataFrame, path: str) -> None:
    """K7: append-only metric log ``(run_id, metric, value, step)``; each call is one version."""
    _write_next(rows, path)


def read_metric_log(spark: SparkSession, path: str, keys=("run_id", "metric", "step")) -> DataFrame:
    """Reader side of K7: a metric logged again for the same step counts once, with the value that
    was logged last; two values in one call are an error."""
    rows = read_versions(spark, path)
    values = [c for c in rows.columns if c not in (*keys, "__version")]
    per_call = rows.groupBy(*keys, "__version").agg(F.min(F.struct(*values)).alias("__lo"), F.max(F.struct(*values)).alias("__hi"))
    last = per_call.groupBy(*keys).agg(F.max_by(F.struct("__lo", "__hi"), "__version").alias("__r"))
    one = F.when(F.col("__r.__lo").eqNullSafe(F.col("__r.__hi")), F.col("__r.__lo")).otherwise(
        F.raise_error(F.lit("a metric has two values for one step in one call")).cast(last.schema["__r"].dataType["__lo"].dataType))
    return last.select(*keys, one.alias("__v")).select(*keys, "__v.*")


def weight_history_wide(hist: DataFrame, n: int, epoch_col: str = "epoch", weights_col: str = "weights") -> DataFrame:
    """K8: ``(epoch, weights ARRAY)`` -> ``epoch, 0, 1, ..., n-1``."""
    return hist.select(F.col(epoch_col).alias("epoch"),
                       *[F.get(F.col(weights_col), i).alias(str(i)) for i in range(n)])


def write_weight_history(hist: DataFrame, path: str, n: int, compact_after: int | None = None) -> DataFrame:
    """K8: wide weight rows appended with K4 semantics."""
    return append_distinct(weight_history_wide(hist, n), path, compact_after)


def write_result_tables(matrices: DataFrame, path: str) -> None:
    """K9: the combined result matrices as one parquet table."""
    matrices.write.mode("overwrite").parquet(path)
