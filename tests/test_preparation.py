"""The preparation job end to end on the provided documents + labels."""
import os

from labelbench.plans.fixtures import labelled_quality
from labelbench.plans.preparation import prepare

from conftest import SF001


def test_prepare_writes_and_profiles(spark, tmp_dir):
    out = prepare(labelled_quality(spark, SF001), os.path.join(tmp_dir, "prep"))
    t = out["table"]
    assert t.count() == labelled_quality(spark, SF001).count()
    total = [r for r in out["class_distribution"].collect() if r.label == "Total"][0]
    assert total.train + total.valid + total.test == t.count()
    assert out["label_check"].count() == 0
    assert {r.split for r in out["token_count"].collect()} == {"train", "valid", "test"}
    assert os.path.isdir(os.path.join(tmp_dir, "prep", "jsonl", "split=train"))
    stats = spark.read.parquet(os.path.join(tmp_dir, "prep", "stats", "token_count_per_class"))
    assert "train_count" in stats.columns and stats.select("seed").first()[0] == 42
    tc = spark.read.parquet(os.path.join(tmp_dir, "prep", "stats", "token_count"))
    assert {r.split for r in tc.collect()} == {"train", "valid", "test"}


def test_prepare_cluster_split(spark):

    from labelbench.plans.fixtures import labelled_text
    out = prepare(labelled_text(spark, SF001).drop("split"), None, split="cluster", ratio_train=0.9)
    got = {r.split for r in out["table"].select("split").distinct().collect()}
    assert got == {"train", "valid", "test"}


def test_prepare_given_and_train_valid(spark):
    from pyspark.sql import functions as F
    from labelbench.plans.fixtures import labelled_text
    lt = labelled_text(spark, SF001)
    given = prepare(lt, None, split="given")
    assert given["table"].count() == lt.count()
    # rows without a split are cut into train / valid; rows with one keep it
    partial = lt.withColumn("split", F.when(F.col("split") == "test", F.lit("test")))
    tv = prepare(partial, None, split="train_valid", ratio_train=0.9)
    got = {r.split: r.n for r in tv["table"].groupBy("split").agg(F.count("*").alias("n")).collect()}
    n_test = lt.where("split = 'test'").count()
    assert got["test"] == n_test and got["train"] + got["valid"] == lt.count() - n_test
    assert got["valid"] > 0
