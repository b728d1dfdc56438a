"""The evaluation and run-analysis jobs end to end on the provided tables."""
import os

from pyspark.sql import functions as F

from labelbench.plans.evaluation import evaluate
from labelbench.plans.fixtures import runs
from labelbench.plans.run_analysis import analyse
from labelbench.session import table

from conftest import SF001


def test_evaluate(spark, tmp_dir):
    e = table(spark, SF001, "events")
    preds = e.select((F.col("user_id") % 3).cast("int").alias("run_id"),
                     F.when(F.col("event_id") % 5 == 0, "test").otherwise("valid").alias("mode"),
                     F.dayofmonth("ts").cast("int").alias("epoch"), F.col("event_id").alias("ex_id"),
                     (F.col("user_id") % 4).cast("int").alias("y_true"),
                     (F.floor("value") % 4).cast("int").alias("y_pred"))
    losses = preds.select("run_id", "mode", "epoch", (F.col("ex_id") % 7).alias("batch"),
                          (F.col("y_true") + 0.5).alias("loss"))
    out = evaluate(preds, losses, out_dir=os.path.join(tmp_dir, "eval"))
    m = out["metrics"]
    groups = preds.select("run_id", "mode", "epoch").distinct().count()
    assert m.count() == groups * 12  # 11 metrics + avg_loss
    assert out["best_epoch"].count() == 3
    assert os.path.isdir(os.path.join(tmp_dir, "eval", "predictions"))


def test_analyse(spark, tmp_dir):
    out = analyse(runs(spark, SF001), out_dir=os.path.join(tmp_dir, "an"))
    assert out["clean"].count() > 0
    assert out["pruned_table"].select("dataset", "hidden_layer_to_use").distinct().count() == \
        out["pruned_table"].count()
    assert out["global_range"].count() == 2
    assert out["tests"].count() == out["cell_stats"].count()


def test_evaluate_without_validation_rows(spark):
    preds = spark.createDataFrame([(1, "train", e, i, i % 2, (i + e) % 2) for e in range(3) for i in range(10)],
                                  "run_id int, mode string, epoch int, ex_id long, y_true int, y_pred int")
    out = evaluate(preds)
    assert out["metrics"].count() == 3 * 11
    assert out["best_epoch"].count() == 0 and out["prediction_files"].count() == 0
