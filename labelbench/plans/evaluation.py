"""Evaluation job: predictions (and batch losses) of every run, mode and epoch
-> metric log, best epoch, prediction files.

Input ``preds(run_id, mode, epoch, ex_id, y_true, y_pred)``; optional
``losses(run_id, mode, epoch, batch, loss[, weight])``.  Metrics are computed
for all (run, mode, epoch) groups in one pass over the confusion counts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import sinks as SK

KEYS = ["run_id", "mode", "epoch"]


def metric_log(preds: DataFrame, losses: DataFrame | None = None, weight_col: str | None = None) -> DataFrame:
    """Long metric table ``(run_id, mode, epoch, metric, value)`` (D14): the 11
    classification metrics per group plus ``avg_loss`` when losses are given."""
    conf = M.confusion_counts(preds, KEYS)
    wide = M.classification_metrics(conf, KEYS)
    long = wide.select(*KEYS, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in M.METRIC_NAMES])).alias("r")) \
        .select(*KEYS, "r.metric", "r.value")
    if losses is not None:
        bl = M.mean_of_batch_loss(losses, "batch", weight_col, KEYS).select(
            *KEYS, F.lit("avg_loss").alias("metric"), F.col("avg_loss").alias("value"))
        long = long.unionByName(bl)
    return long


def evaluate(preds: DataFrame, losses: DataFrame | None = None, benchmark: str = "acc",
             out_dir: str | None = None, weight_col: str | None = None) -> dict:
    """Metrics, running best and best epoch on the validation mode, and the
    prediction files (last epoch, last improvement) of every run.  With
    ``out_dir`` the metric log is written first and everything after it reads
    the written log (computed once, survives lost executors)."""
    log = metric_log(preds, losses, weight_col)
    if out_dir:
        path = os.path.join(out_dir, "metrics")
        SK.log_metrics(log.withColumn("step", F.col("epoch").cast("long")), path)
        log = SK.read_metric_log(log.sparkSession, path, ("run_id", "mode", "epoch", "metric")).drop("step")
    valid = log.where((F.col("mode") == "valid") & (F.col("metric") == benchmark)) \
               .select("run_id", "epoch", F.col("epoch").cast("long").alias("step"), "value")
    flags = M.running_best(valid)
    best = M.best_epoch(valid)
    files = M.prediction_files(preds.where(F.col("mode") == "valid").drop("mode"), flags, "valid", benchmark)
    if out_dir:
        SK.write_predictions(files, os.path.join(out_dir, "predictions"), value_col="y_pred")
    return {"metrics": log, "running_best": flags, "best_epoch": best, "prediction_files": files}
