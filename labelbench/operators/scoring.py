"""Classification heads on pooled vectors.

Heads are JVM expressions over weight literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import linear, vsum


def score_linear(pooled: DataFrame, weights, bias=None, key: str = "example_id",
                 vec: str = "vec") -> DataFrame:
    """logits = W x + b (dropout is the identity when scoring)."""
    return pooled.select(key, linear(vec, weights, bias).alias("logits"))


def score_dense_tanh(pooled: DataFrame, w1, b1, w2, b2, key: str = "example_id",
                     vec: str = "vec") -> DataFrame:
    """logits = W2 tanh(W1 x + b1) + b2; the hidden values are bound once."""
    hidden = F.transform(linear(vec, w1, b1), lambda x: F.tanh(x))
    logits = F.get(F.transform(F.array(hidden), lambda h: linear(h, w2, b2)), 0)
    return pooled.select(key, logits.alias("logits"))


def fit_head_steps(train: DataFrame, n_classes: int, width: int, steps: int, rate: float,
                   features: str = "vec", label: str = "label"):
    """V19 by full-gradient steps from zero weights: the mean gradient of the cross-entropy is one
    aggregate over the rows per step; the driver holds the weights (n_classes x width) alone.
    Returns (weights, bias)."""
    w, b = [[0.0] * width for _ in range(n_classes)], [0.0] * n_classes
    n = train.count()
    for _ in range(steps if n else 0):
        logits = train.select(F.col(features).alias("x"), F.col(label).alias("y"), linear(features, w, b).alias("z"))
        top = logits.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
        rest = top.select("x", "y", F.posexplode(F.transform("e", lambda v: v / vsum("e"))).alias("cls", "p"))
        r = F.col("p") - F.when(F.col("y") == F.col("cls"), 1.0).otherwise(0.0)
        sums = rest.groupBy("cls").agg(F.sum(r).alias("b"), *[F.sum(r * F.get("x", F.lit(j))).alias(f"g{j}") for j in range(width)])
        for g in sums.collect():
            b[g.cls] -= rate * g.b / n
            w[g.cls] = [v - rate * g[f"g{j}"] / n for j, v in enumerate(w[g.cls])]
    return w, b


def fit_head(train: DataFrame, features: str = "vec", label: str = "label",
             weight: str | None = None, max_iter: int = 100):
    """One linear layer with cross-entropy on frozen vectors (multinomial
    logistic regression, no regularisation).  Same loss as the original head,
    other optimiser: compare metrics, not weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df = train.withColumn("__features", array_to_vector(F.col(features)))
    lr = LogisticRegression(featuresCol="__features", labelCol=label, family="multinomial",
                            regParam=0.0, standardization=False, maxIter=max_iter)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(df)


def predict_head(model, df: DataFrame, features: str = "vec") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    out = model.transform(df.withColumn("__features", array_to_vector(F.col(features))))
    return out.drop("__features", "rawPrediction", "probability")
