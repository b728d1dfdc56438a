"""Classifier evaluation from prediction rows (A20-A25, W4, K3 selection).

Predictions are rows, never collected.  Everything is computed from the
confusion counts (A20): one partial aggregation over the predictions, after
which every table is classes x classes per group and tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cross_entropy

METRIC_NAMES = ["acc", "balanced_acc", "precision_micro", "recall_micro", "f1_micro",
                "precision_macro", "recall_macro", "f1_macro",
                "precision_weighted", "recall_weighted", "f1_weighted"]


def _div0(a, b):
    """0/0 -> 0 (sklearn's zero_division default)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(pred: DataFrame, group_cols=("task",), y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """(group, y_true, y_pred) -> n."""
    return pred.groupBy(*group_cols, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(conf: DataFrame, group_cols=("task",), y_true: str = "y_true",
                 y_pred: str = "y_pred") -> DataFrame:
    """Per class of the union of true and predicted labels: tp, fp, fn,
    support, precision, recall, f1 (0 where undefined)."""
    g = list(group_cols)
    n = F.col("n").cast("long")
    zero = F.lit(0).cast("long")
    hit = F.when(F.col(y_true) == F.col(y_pred), n).otherwise(zero)
    # every confusion cell counts once for its true class and once for its
    # predicted class: one aggregation over the union of both label sets
    parts = conf.select(*g, F.explode(F.array(
        F.struct(F.col(y_true).alias("cls"), n.alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col(y_pred).alias("cls"), zero.alias("s"), n.alias("p"), zero.alias("t")))).alias("r"))
    r = parts.groupBy(*g, F.col("r.cls").alias("cls")).agg(
        F.sum("r.t").cast("long").alias("tp"), F.sum("r.p").cast("long").alias("predicted"),
        F.sum("r.s").cast("long").alias("support"))
    r = (r.withColumn("fp", F.col("predicted") - F.col("tp"))
         .withColumn("fn", F.col("support") - F.col("tp"))
         .withColumn("precision", _div0(F.col("tp"), F.col("predicted")))
         .withColumn("recall", _div0(F.col("tp"), F.col("support"))))
    r = r.withColumn("f1", _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return r.select(*g, "cls", "tp", "fp", "fn", "support", "precision", "recall", "f1")


def classification_metrics(conf: DataFrame, group_cols=("task",), y_true: str = "y_true",
                           y_pred: str = "y_pred") -> DataFrame:
    """A21 + A22: accuracy, balanced accuracy (mean recall over classes present
    in y_true) and precision/recall/F1 x micro/macro/weighted; macro over the
    union of true and predicted classes, weighted by true support."""
    g = list(group_cols)
    rep = class_report(conf, g, y_true, y_pred)
    agg = rep.groupBy(*g).agg(
        F.sum("tp").alias("__tp"), F.sum("support").alias("__n"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_acc"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        _div0(F.sum(F.col("support") * F.col("precision")), F.sum("support")).alias("precision_weighted"),
        _div0(F.sum(F.col("support") * F.col("recall")), F.sum("support")).alias("recall_weighted"),
        _div0(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("f1_weighted"))
    acc = _div0(F.col("__tp"), F.col("__n"))
    return agg.select(*g, acc.alias("acc"), "balanced_acc",
                      acc.alias("precision_micro"), acc.alias("recall_micro"), acc.alias("f1_micro"),
                      "precision_macro", "recall_macro", "f1_macro",
                      "precision_weighted", "recall_weighted", "f1_weighted")


def row_losses(logits_df: DataFrame, logits_col: str = "logits", y_col: str = "y",
               ignore_index: int = -100) -> DataFrame:
    """X18 per row; rows with the ignore label are dropped."""
    return (logits_df.where(F.col(y_col) != ignore_index)
            .withColumn("loss", cross_entropy(logits_col, y_col)))


def mean_of_batch_loss(losses: DataFrame, batch_col: str = "batch", weight_col: str | None = None,
                       group_cols=()) -> DataFrame:
    """Mean over batches of the batch loss (a short last batch weighs as
    much as a full one).  With weights the batch loss is sum(w l) / sum(w)."""
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    per_batch = losses.groupBy(*group_cols, batch_col).agg(
        (F.sum(w * F.col("loss")) / F.sum(w)).alias("batch_loss"), F.count(F.lit(1)).alias("rows"))
    return per_batch.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg("batch_loss").alias("avg_loss"),
        (F.sum(F.col("batch_loss") * F.col("rows")) / F.sum("rows")).alias("row_weighted_loss"))


def running_best(log: DataFrame, run_cols=("run_id",), epoch_col: str = "epoch",
                 value_col: str = "value", start: float = -1.0) -> DataFrame:
    """Flag an epoch whose metric is strictly above every earlier epoch
    (and above ``start``)."""
    w = (Window.partitionBy(*run_cols).orderBy(epoch_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    prev = F.coalesce(F.max(value_col).over(w), F.lit(start))
    return log.withColumn("is_best", F.col(value_col) > F.greatest(prev, F.lit(start)))


def best_epoch(log: DataFrame, run_cols=("run_id",), epoch_col: str = "epoch",
               step_col: str = "step", value_col: str = "value", start: float = -1.0) -> DataFrame:
    """Earliest epoch with the greatest metric (strict improvement over
    ``start``), with its global step; one aggregate per run, no window."""
    cand = log.where(F.col(value_col) > start)
    key = F.struct(F.col(value_col), (-F.col(epoch_col)).alias("neg_epoch"))
    best = F.max_by(F.struct(F.col(epoch_col).alias("e"), F.col(step_col).alias("s"),
                             F.col(value_col).alias("v")), key)
    return (cand.groupBy(*run_cols).agg(best.alias("b"))
            .select(*run_cols, F.col("b.e").alias("best_epoch"), F.col("b.s").alias("step_at_best_epoch"),
                    F.col("b.v").alias("best_value")))


def prediction_files(preds: DataFrame, log_flags: DataFrame, mode: str = "valid",
                     metric: str = "acc", run_cols=("run_id",), epoch_col: str = "epoch") -> DataFrame:
    """K3 selection: ``pred_{mode}_last`` = predictions of the last epoch;
    ``pred_{mode}_best_{metric}`` = predictions of the last epoch that
    improved the best value (the file is overwritten at each improvement)."""
    r = list(run_cols)
    last = preds.groupBy(*r).agg(F.max(epoch_col).alias("__e"))
    best = (log_flags.where("is_best").groupBy(*r).agg(F.max(epoch_col).alias("__e")))
    a = (preds.join(last, r).where(F.col(epoch_col) == F.col("__e"))
         .withColumn("file", F.lit(f"pred_{mode}_last")).drop("__e"))
    b = (preds.join(best, r).where(F.col(epoch_col) == F.col("__e"))
         .withColumn("file", F.lit(f"pred_{mode}_best_{metric}")).drop("__e"))
    return a.unionByName(b)
