"""W2, W3, W5, W6, J1, J2, T1 and the two-phase rank."""
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelbench.operators import splits as SP
from labelbench.operators.rank import hex_bucket, two_phase_row_number
from labelbench.plans.fixtures import labelled_quality, labelled_text

from conftest import SF01


def _quota_py(counts, n_draws):
    # largest remainder with ties in label order
    total = sum(counts.values())
    fl = {k: (v * n_draws) // total for k, v in counts.items()}
    rem = {k: (v * n_draws) % total for k, v in counts.items()}
    need = n_draws - sum(fl.values())
    for k in sorted(counts, key=lambda k: (-rem[k], k))[:need]:
        fl[k] += 1
    return fl


def test_stratified_quotas(spark):
    lt = labelled_text(spark, SF01).drop("split")
    out = SP.stratified_split(lt, "label", "ord", 0.1, seed=42)
    got = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    counts = {r.label: r.n for r in lt.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    n_test = math.ceil(0.1 * n)
    q = _quota_py(counts, n - n_test)
    for k, v in counts.items():
        assert got[(k, "train")] == q[k]
        assert got.get((k, "test"), 0) == v - q[k]


def test_split_stable_under_repartition(spark):
    lq = labelled_quality(spark, SF01)
    ref = sorted(SP.three_way_split(lq, "label", "ord").select("ord", "split").collect())
    for n in (1, 5, 16):
        got = sorted(SP.three_way_split(lq.repartition(n), "label", "ord").select("ord", "split").collect())
        assert got == ref


def _ranked_reference(df, cuts, seed):
    """Splits by a plain window rank; ``cuts``: label -> (rows of train, rows up to valid)."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(SP.seeded_key(seed, "id"), "id"))
    return sorted(((r.id, "train" if r.rn <= cuts[r.label][0] else "valid" if r.rn <= cuts[r.label][1] else "test")
                   for r in df.withColumn("rn", rank).collect()), key=repr)


@pytest.mark.parametrize("ranked_rows", [0, 3, 10**6])
def test_borders_equal_a_full_ranking(spark, ranked_rows):
    """However deep the digits are counted before rows are ranked, NULL labels and ids included."""
    rows = [(i, "a" if i % 3 else None if i % 2 else "b", "x") for i in range(700)] + [(None, "a", "x")]
    df = spark.createDataFrame(rows, "id long, label string, src string").repartition(5)
    counts = {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    order = lambda q: {k: q[k or ""] for k in counts}
    train = order(_quota_py({k or "": v for k, v in counts.items()}, n - math.ceil((1.0 - 0.8) * n)))
    rest = {k: counts[k] - train[k] for k in counts}
    m = sum(rest.values())
    valid = order(_quota_py({k or "": v for k, v in rest.items()}, m - math.ceil(0.5 * m)))
    want = _ranked_reference(df, {k: (train[k], train[k] + valid[k]) for k in counts}, 9)
    got = SP.three_way_split(df, "label", "id", seed=9, ranked_rows=ranked_rows)
    full = SP.three_way_split(df, "label", "id", seed=9, most_classes=0)
    assert got.columns == full.columns == ["id", "label", "src", "split"]
    key = lambda r: (r.id is None, r.id or 0, r.split)
    assert sorted(got.collect(), key=key) == sorted(full.collect(), key=key)
    assert sorted(((r.id, r.split) for r in got.collect()), key=repr) == want


def test_shared_ids_across_a_border_keep_the_quotas(spark):
    df = spark.createDataFrame([(i // 40, "ab"[i % 2]) for i in range(400)], "id long, label string")
    out = SP.stratified_split(df, "label", "id", 0.25)
    got = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "train"): 150, ("a", "test"): 50, ("b", "train"): 150, ("b", "test"): 50}


def test_two_phase_rank_equals_single_window(spark):
    lt = labelled_text(spark, SF01).withColumn("k", SP.seeded_key(42, "ord"))
    a = two_phase_row_number(lt, ["label"], "k", hex_bucket("k", 2), out="rn")
    b = lt.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("k")))
    assert sorted(a.select("ord", "rn").collect()) == sorted(b.select("ord", "rn").collect())


def test_one_row_class_is_an_error(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(99, "b")], "ord long, label string")
    with pytest.raises(Exception, match="fewer than 2"):
        SP.stratified_split(df, "label", "ord", 0.3).collect()


def test_three_way_sizes(spark):
    lq = labelled_quality(spark, SF01)
    out = {r.split: r.n for r in SP.three_way_split(lq, "label", "ord").groupBy("split").agg(
        F.count("*").alias("n")).collect()}
    n = lq.count()
    rest = math.ceil((1 - 0.8) * n)
    assert out["train"] == n - rest
    assert out["test"] == math.ceil(0.5 * rest)
    assert out["valid"] == rest - out["test"]


def test_positional_clusters(spark):
    df = spark.range(23).withColumnRenamed("id", "ord")
    out = SP.positional_clusters(df).groupBy("cluster", "part").count().orderBy("cluster").collect()
    # c = 23 // 5 + 1 = 5 -> clusters of 5,5,5,5,3
    assert [(r.cluster, r.part, r["count"]) for r in out] == [
        (0, "pool", 5), (1, "pool", 5), (2, "pool", 5), (3, "test", 5), (4, "test", 3)]


def test_split_by_index_and_id(spark):
    ex = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "ord long, src string")
    idx = spark.createDataFrame([(0, "train"), (0, "test"), (2, "train"), (2, "train"), (5, "valid")],
                                "ord long, split string")
    got = sorted((r.ord, r.split) for r in SP.split_by_index(ex, idx).collect())
    assert got == [(0, "test"), (0, "train"), (2, "train"), (5, "valid")]
    pool = spark.createDataFrame([("a",), ("b",), ("c",)], "ex_id string")
    tr = spark.createDataFrame([("b",)], "ex_id string")
    assert sorted((r.ex_id, r.split) for r in SP.split_by_id(pool, tr).collect()) == [
        ("a", "valid"), ("b", "train"), ("c", "valid")]


def test_batches_drop_last(spark):
    df = spark.range(130).withColumnRenamed("id", "ex")
    b = SP.shuffle_into_batches(df, "ex", 64, seed=1, drop_last=True)
    assert b.count() == 128 and b.select("batch").distinct().count() == 2
    keep = SP.shuffle_into_batches(df, "ex", 64, seed=1, drop_last=False)
    assert keep.count() == 130 and keep.where("batch = 2").count() == 2


def test_debug_subset(spark):
    out = SP.debug_subset(labelled_text(spark, SF01), "cpu")
    got = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 16, "valid": 2, "test": 2}


def test_describe_numeric_label(spark):
    from labelbench.operators.profile import describe_columns
    df = spark.createDataFrame([("train", 3, 1), ("train", 5, 0), ("test", 4, 1)],
                               "split string, n_tokens int, label int")
    got = {(r.split, r.column): (r["count"], r["mean"]) for r in describe_columns(df, ["n_tokens", "label"]).collect()}
    assert got[("train", "n_tokens")] == (2, 4.0) and got[("train", "label")] == (2, 0.0)
    assert got[("test", "label")] == (1, 1.0)


def test_hot_label_is_spread_over_buckets(spark):
    # one label holds 90% of the rows: its ranking must not sit in one window partition
    n = 60000
    df = spark.range(n).select(F.col("id").alias("ord"),
                               F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("label"))
    out = SP.three_way_split(df, "label", "ord", 0.8, 0.1, 0.1, seed=3)
    got = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == n
    assert got[("hot", "train")] == 43200 and got[("rare", "train")] == 4800
    keyed = df.withColumn("k", SP.seeded_key(3, "ord")).withColumn("b", hex_bucket("k", 4))
    per_bucket = keyed.where("label = 'hot'").groupBy("b").count()
    assert per_bucket.count() > 20000 and per_bucket.agg(F.max("count")).first()[0] < 20


def test_cluster_split(spark):
    import math
    df = spark.range(103).select(F.col("id").alias("ord"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("ex_id"),
                                 (F.col("id") % 3).cast("string").alias("label"))
    out = SP.cluster_split(df, "label", "ex_id", ratio_train=0.9, seed=1)
    got = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    size = 103 // 5 + 1                        # 21 per cluster
    pool = 3 * size                            # 63
    assert got["test"] == 103 - pool
    assert got["valid"] == math.ceil(0.1 * pool) and got["train"] == pool - got["valid"]


def test_first_examples_strict(spark):
    import pytest as _pytest
    from labelbench.operators.profile import first_examples
    df = spark.createDataFrame([(0, "a b", "train"), (1, "c", "train"), (2, "d", "test")],
                               "ord long, src string, split string")
    assert first_examples(df, 3).count() == 3
    with _pytest.raises(Exception, match="fewer than 3 examples"):
        first_examples(df, 3, strict=True).collect()


def test_quotas_random_class_sizes(spark):
    import random
    rng = random.Random(7)
    for _ in range(12):
        k = rng.randint(2, 5)
        counts = {f"c{i}": rng.randint(2, 60) for i in range(k)}
        if rng.random() < 0.3:  # equal class sizes give equal remainders: ties by label order
            counts = {c: 20 for c in counts}
        t = rng.choice([0.1, 0.2, 0.25, 0.5])
        rows = [(j * 10 + i, c) for i, (c, n) in enumerate(counts.items()) for j in range(n)]
        df = spark.createDataFrame(rows, "ord long, label string")
        total = sum(counts.values())
        n_test = math.ceil(t * total)
        if total - n_test < k or n_test < k:
            continue
        got = {r.label: r.n for r in SP.stratified_split(df, "label", "ord", t, seed=3)
               .where("split = 'train'").groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert got == _quota_py(counts, total - n_test), (counts, t)


def test_three_way_random_against_rule(spark):
    import random
    rng = random.Random(12)
    for _ in range(8):
        counts = {f"c{i}": rng.randint(10, 80) for i in range(rng.randint(2, 4))}
        n = sum(counts.values())
        n_rest = math.ceil((1 - 0.8) * n)
        train = _quota_py(counts, n - n_rest)
        rest = {c: counts[c] - train[c] for c in counts}
        if min(rest.values()) < 2:
            continue
        valid = _quota_py(rest, n_rest - math.ceil(0.5 * n_rest))
        rows = [(j * 10 + i, c) for i, (c, k) in enumerate(counts.items()) for j in range(k)]
        out = SP.three_way_split(spark.createDataFrame(rows, "ord long, label string"), "label", "ord", seed=5)
        got = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
        for c in counts:
            assert got[(c, "train")] == train[c] and got[(c, "valid")] == valid[c]
            assert got[(c, "test")] == counts[c] - train[c] - valid[c]
