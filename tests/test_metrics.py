"""A20-A25, W4, X17, X18 against a plain-Python version."""
import math

import pytest
from pyspark.sql import functions as F

from labelbench.functions.vectors import argmax, cross_entropy
from labelbench.operators import metrics as M


def py_metrics(yt, yp):
    labels = sorted(set(yt) | set(yp))
    tp = {c: sum(1 for a, b in zip(yt, yp) if a == b == c) for c in labels}
    sup = {c: yt.count(c) for c in labels}
    prd = {c: yp.count(c) for c in labels}
    P = {c: tp[c] / prd[c] if prd[c] else 0.0 for c in labels}
    R = {c: tp[c] / sup[c] if sup[c] else 0.0 for c in labels}
    F1 = {c: 2 * tp[c] / (prd[c] + sup[c]) if prd[c] + sup[c] else 0.0 for c in labels}
    n = len(yt)
    acc = sum(tp.values()) / n
    present = [c for c in labels if sup[c] > 0]
    out = {"acc": acc, "balanced_acc": sum(R[c] for c in present) / len(present),
           "precision_micro": acc, "recall_micro": acc, "f1_micro": acc}
    for name, d in (("precision", P), ("recall", R), ("f1", F1)):
        out[f"{name}_macro"] = sum(d.values()) / len(labels)
        out[f"{name}_weighted"] = sum(d[c] * sup[c] for c in labels) / n
    return out


CASES = {
    "pred_never_true": ([0, 0, 1, 1, 1], [0, 2, 1, 1, 0]),
    "true_never_pred": ([0, 1, 2, 2, 2], [0, 1, 1, 1, 0]),
    "single_class": ([1, 1, 1], [1, 1, 1]),
    "all_wrong": ([0, 1, 0, 1], [1, 0, 1, 0]),
    "multiclass": ([0, 1, 2, 3, 3, 2, 1, 0, 0, 4], [0, 2, 2, 3, 1, 2, 1, 4, 0, 4]),
}


@pytest.mark.parametrize("case", list(CASES))
def test_classification_metrics(spark, case):
    yt, yp = CASES[case]
    df = spark.createDataFrame([("t", a, b) for a, b in zip(yt, yp)], "task string, y_true int, y_pred int")
    got = M.classification_metrics(M.confusion_counts(df)).first().asDict()
    want = py_metrics(yt, yp)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


def test_argmax_and_cross_entropy(spark):
    rows = [([1.0, 3.0, 3.0], 1), ([float("nan"), 1.0], 0), ([-2.0, -1.0, -5.0], 2)]
    df = spark.createDataFrame(rows, "l array<double>, y int")
    out = df.select(argmax("l").alias("a"), cross_entropy("l", "y").alias("ce")).collect()
    assert [r.a for r in out] == [1, 0, 1]  # first max; NaN counts as greatest
    for (l, y), r in zip(rows, out):
        if any(math.isnan(x) for x in l):
            continue
        m = max(l)
        assert r.ce == pytest.approx(math.log(sum(math.exp(x - m) for x in l)) + m - l[y])


def test_mean_of_batch_loss_weighs_batches_equally(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 1.0), (1, 10.0, 1.0)], "batch int, loss double, w double")
    r = M.mean_of_batch_loss(df, "batch", "w").first()
    assert r.avg_loss == pytest.approx((2.0 + 10.0) / 2)
    assert r.row_weighted_loss == pytest.approx(14.0 / 3)
    w = spark.createDataFrame([(0, 1.0, 3.0), (0, 3.0, 1.0)], "batch int, loss double, w double")
    assert M.mean_of_batch_loss(w, "batch", "w").first().avg_loss == pytest.approx(6.0 / 4)


def test_running_best_and_best_epoch(spark):
    log = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 10, 0.7), (1, 2, 20, 0.7), (1, 3, 30, 0.6),
                                 (2, 0, 0, -2.0), (2, 1, 5, -1.5)], "run_id int, epoch int, step int, value double")
    flags = {(r.run_id, r.epoch): r.is_best for r in M.running_best(log).collect()}
    assert flags == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): False, (2, 0): False, (2, 1): False}
    best = {r.run_id: (r.best_epoch, r.step_at_best_epoch) for r in M.best_epoch(log).collect()}
    assert best == {1: (1, 10)}  # earliest of the ties; run 2 never beats the start value -1


def test_fit_head_separates_classes(spark):
    from labelbench.operators import scoring as SC
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)], float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "example_id long, vec array<double>, label double")
    model = SC.fit_head(df, "vec", "label", max_iter=50)
    pred = SC.predict_head(model, df)
    m = M.classification_metrics(M.confusion_counts(
        pred.select(F.lit("t").alias("task"), F.col("label").cast("int").alias("y_true"),
                    F.col("prediction").cast("int").alias("y_pred")))).first()
    assert m.acc == 1.0


def test_metrics_random_labels(spark):
    import random
    rng = random.Random(5)
    cases = {}
    for g in range(15):
        n = rng.randint(1, 40)
        kt, kp = rng.randint(1, 6), rng.randint(1, 6)
        cases[f"t{g}"] = ([rng.randrange(kt) for _ in range(n)], [rng.randrange(kp) for _ in range(n)])
    rows = [(g, a, b) for g, (yt, yp) in cases.items() for a, b in zip(yt, yp)]
    df = spark.createDataFrame(rows, "task string, y_true int, y_pred int")
    got = {r.task: r.asDict() for r in M.classification_metrics(M.confusion_counts(df)).collect()}
    for g, (yt, yp) in cases.items():
        for k, v in py_metrics(yt, yp).items():
            assert got[g][k] == pytest.approx(v, abs=1e-12), (g, k)
