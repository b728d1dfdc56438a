"""Registered queries of the evaluation block: X17, X18, A20-A25, W4, K3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import profile as PR
from ..session import table
from ..functions.timefmt import stable
from .fixtures import epoch_metrics, logits, predictions, with_views
from .sqlparts import sround

QUERIES = {}


def _r6(df, cols):
    return df.select(*[F.round(stable(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _x17(spark, sf):
    lg = logits(spark, sf)
    return lg.select("ex_id", V.argmax("logits").alias("argmax"))


QUERIES["X17_argmax"] = (_x17, with_views(
    "SELECT ex_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS argmax FROM logits", "logits"))

SQL_LOSS = ("loss AS (SELECT ex_id, y, batch, ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) + m - logits[y + 1] AS loss\n"
            "  FROM (SELECT *, list_max(logits) AS m FROM logits) WHERE y <> -100)")


def _x18(spark, sf):
    return M.row_losses(logits(spark, sf)).select("ex_id", F.round(stable("loss"), 6).alias("loss"))


QUERIES["X18_cross_entropy"] = (_x18, with_views(f"SELECT ex_id, {sround('loss', 6)} AS loss FROM loss", "logits",
                                                 ctes=[SQL_LOSS]))


def _a20(spark, sf):
    return M.confusion_counts(predictions(spark, sf))


QUERIES["A20_confusion_counts"] = (_a20, with_views(
    "SELECT task, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL", "predictions"))

SQL_REPORT = [
    "conf AS (SELECT task, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL)",
    "sup AS (SELECT task, y_true AS cls, sum(n) AS support FROM conf GROUP BY ALL)",
    "prd AS (SELECT task, y_pred AS cls, sum(n) AS predicted FROM conf GROUP BY ALL)",
    "tpc AS (SELECT task, y_true AS cls, sum(n) AS tp FROM conf WHERE y_true = y_pred GROUP BY ALL)",
    """rep0 AS (SELECT coalesce(s.task, p.task) AS task, coalesce(s.cls, p.cls) AS cls,
   CAST(coalesce(s.support, 0) AS BIGINT) AS support, CAST(coalesce(p.predicted, 0) AS BIGINT) AS predicted
   FROM sup s FULL OUTER JOIN prd p ON s.task = p.task AND s.cls = p.cls)""",
    """rep1 AS (SELECT r.task, r.cls, CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, r.predicted, r.support
   FROM rep0 r LEFT JOIN tpc t ON r.task = t.task AND r.cls = t.cls)""",
    """rep AS (SELECT task, cls, tp, predicted - tp AS fp, support - tp AS fn, support,
   CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
   CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
   CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp / (predicted + support) END AS f1 FROM rep1)""",
]


def _a23(spark, sf):
    rep = M.class_report(M.confusion_counts(predictions(spark, sf)))
    return _r6(rep, {"precision", "recall", "f1"})


QUERIES["A23_class_report"] = (_a23, with_views(
    f"SELECT task, cls, tp, fp, fn, support, {sround('precision', 6)} AS precision, {sround('recall', 6)} AS recall, "
    f"{sround('f1', 6)} AS f1 FROM rep", "predictions", ctes=SQL_REPORT))


def _metrics(spark, sf):
    return M.classification_metrics(M.confusion_counts(predictions(spark, sf)))


SQL_METRICS = [*SQL_REPORT, """met AS (SELECT task, sum(tp) / sum(support) AS acc,
   avg(CASE WHEN support > 0 THEN recall END) AS balanced_acc,
   avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
   sum(support * precision) / sum(support) AS precision_weighted,
   sum(support * recall) / sum(support) AS recall_weighted,
   sum(support * f1) / sum(support) AS f1_weighted FROM rep GROUP BY task)"""]


def _a21(spark, sf):
    return _r6(_metrics(spark, sf).select("task", "acc", "balanced_acc"), {"acc", "balanced_acc"})


QUERIES["A21_accuracy_balanced"] = (_a21, with_views(
    f"SELECT task, {sround('acc', 6)} AS acc, {sround('balanced_acc', 6)} AS balanced_acc FROM met", "predictions",
    ctes=SQL_METRICS))

_A22 = ["precision_micro", "recall_micro", "f1_micro", "precision_macro", "recall_macro", "f1_macro",
        "precision_weighted", "recall_weighted", "f1_weighted"]


def _a22(spark, sf):
    return _r6(_metrics(spark, sf).select("task", *_A22), set(_A22))


QUERIES["A22_precision_recall_f1"] = (_a22, with_views(
    f"SELECT task, {sround('acc', 6)} AS precision_micro, {sround('acc', 6)} AS recall_micro, "
    f"{sround('acc', 6)} AS f1_micro, " + ", ".join(f"{sround(c, 6)} AS {c}" for c in _A22[3:]) + " FROM met",
    "predictions", ctes=SQL_METRICS))


def _a24(spark, sf):
    lg = logits(spark, sf)
    w = PR.class_weights(lg.withColumnRenamed("y", "label")).select(
        F.col("label").alias("y"), F.col("weight").alias("w"))
    losses = M.row_losses(lg).join(w, "y")
    out = M.mean_of_batch_loss(losses, "batch", "w")
    return _r6(out, {"avg_loss", "row_weighted_loss"})


QUERIES["A24_mean_of_batch_loss"] = (_a24, with_views(
    f"SELECT CAST(count(*) AS BIGINT) AS n_batches, {sround('avg(bl)', 6)} AS avg_loss,\n"
    f"  {sround('sum(bl * rows) / sum(rows)', 6)} AS row_weighted_loss FROM (\n"
    "  SELECT batch, sum(w * loss) / sum(w) AS bl, count(*) AS rows FROM loss JOIN\n"
    "    (SELECT y, count(*) / sum(count(*)) OVER () AS w FROM logits GROUP BY y) USING (y) GROUP BY batch)",
    "logits", ctes=[SQL_LOSS]))


def _w4(spark, sf):
    return M.running_best(epoch_metrics(spark, sf)).select("run_id", "epoch", "value", "is_best")


SQL_W4 = ("SELECT run_id, epoch, value, value > greatest(coalesce(max(value) OVER (PARTITION BY run_id ORDER BY epoch "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), -1.0) AS is_best FROM epoch_metrics")
QUERIES["W4_running_best"] = (_w4, with_views(SQL_W4, "epoch_metrics"))


def _a25(spark, sf):
    return M.best_epoch(epoch_metrics(spark, sf))


QUERIES["A25_best_epoch"] = (_a25, with_views(
    "SELECT run_id, epoch AS best_epoch, step AS step_at_best_epoch, value AS best_value FROM (\n"
    "  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, epoch) AS rn FROM epoch_metrics\n"
    "  WHERE value > -1.0) WHERE rn = 1", "epoch_metrics"))


def _preds_by_epoch(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 10).cast("int").alias("run_id"),
                    F.dayofmonth("ts").cast("int").alias("epoch"),
                    F.col("event_id").alias("ex_id"),
                    (F.floor("value") % 10).cast("int").alias("pred"))


def _k3(spark, sf):
    flags = M.running_best(epoch_metrics(spark, sf))
    return M.prediction_files(_preds_by_epoch(spark, sf), flags, "valid", "acc").select(
        "run_id", "file", "epoch", "ex_id", "pred")


QUERIES["K3_write_predictions"] = (_k3, with_views(
    "SELECT p.run_id, 'pred_valid_last' AS file, p.epoch, p.ex_id, p.pred FROM preds p\n"
    "  JOIN (SELECT run_id, max(epoch) AS e FROM preds GROUP BY run_id) l ON p.run_id = l.run_id AND p.epoch = l.e\n"
    "UNION ALL\n"
    "SELECT p.run_id, 'pred_valid_best_acc', p.epoch, p.ex_id, p.pred FROM preds p\n"
    "  JOIN (SELECT run_id, max(epoch) AS e FROM flags WHERE is_best GROUP BY run_id) b ON p.run_id = b.run_id AND p.epoch = b.e",
    "epoch_metrics",
    ctes=["preds AS (SELECT CAST(user_id % 10 AS INTEGER) AS run_id, CAST(day(ts) AS INTEGER) AS epoch, event_id AS ex_id, "
          "CAST(CAST(floor(value) AS BIGINT) % 10 AS INTEGER) AS pred FROM events)",
          "flags AS (" + SQL_W4 + ")"]))
