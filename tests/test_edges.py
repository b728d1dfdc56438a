"""Edge cases of operators used by the jobs."""
import os

import pytest
from pyspark.sql import functions as F


from labelbench.operators import metrics as M
from labelbench.operators import profile as PR
from labelbench.operators import splits as SP
from labelbench.sources import readers as RD
from labelbench.sources import sinks as SK


def test_class_distribution_with_an_empty_split(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("a", "test")], "label string, split string")
    rows = {r.label: (r.train, r.valid, r.test) for r in PR.class_distribution(df).collect()}
    assert rows == {"a": (1, None, 1), "b": (1, None, None), "Total": (2, 0, 1)}


def test_class_distribution_raises_on_an_unknown_split(spark):
    for odd in ("dev", None):
        df = spark.createDataFrame([("a", "train"), ("b", odd)], "label string, split string")
        with pytest.raises(Exception, match="unknown split"):
            PR.class_distribution(df).collect()


def test_three_way_split_rest_needs_two_rows_per_class(spark):
    # 10 rows of 'a', 3 of 'b': the rest keeps 1 'b' row -> the second cut cannot stratify
    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(3)],
                               "ord long, label string")
    with pytest.raises(Exception, match="in the rest|side smaller"):
        SP.three_way_split(df, "label", "ord", 0.8, 0.1, 0.1).collect()


def test_batch_loss_ignores_label_minus_100(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0], 1), (0, [0.0, 1.0], -100), (1, [2.0, 0.0], 0)],
                               "batch int, logits array<double>, y int")
    losses = M.row_losses(df)
    assert losses.count() == 2
    r = M.mean_of_batch_loss(losses, "batch").first()
    assert r.n_batches == 2


def test_prediction_files_keep_example_order_across_part_files(spark, tmp_dir):
    rows = [(1, "pred_valid_last", i, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id int, file string, ex_id long, pred int").repartition(7)
    path = os.path.join(tmp_dir, "preds")
    SK.write_predictions(df, path, partitions=4)
    folder = os.path.join(path, "run_id=1", "file=pred_valid_last")
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    assert len(parts) > 1
    lines = [ln.strip() for p in parts for ln in open(os.path.join(folder, p))]
    assert lines == [str(i % 3) for i in range(200)]


def test_empty_json_array_file(spark, tmp_dir):
    p = os.path.join(tmp_dir, "empty.json")
    with open(p, "w") as f:
        f.write("[]")
    q = os.path.join(tmp_dir, "one.json")
    with open(q, "w") as f:
        f.write('[{"func": "x", "target": 1}]')
    df = RD.read_json_array(spark, [p, q], "struct<func:string,target:int>")
    assert [(r.ord, r.func) for r in df.collect()] == [(0, "x")]



def test_null_labels_are_a_class(spark):
    df = spark.createDataFrame([(i, None if i < 4 else ("a" if i % 2 else "b")) for i in range(40)],
                               "ord long, label string")
    out = SP.three_way_split(df, "label", "ord")
    assert out.count() == 40
    assert out.where("label IS NULL").count() == 4


def test_repeated_key_keeps_first_position_last_value(spark, tmp_dir):
    import json
    from collections import OrderedDict
    text = ('{"k1": {"code_string": "a", "err_obj": {"msg": "invalid syntax"}}, '
            '"k2": {"code_string": "b", "err_obj": {"msg": "invalid syntax"}}, '
            '"k1": {"code_string": "c", "err_obj": {"msg": "unexpected indent"}}}')
    p = os.path.join(tmp_dir, "o.json")
    with open(p, "w") as f:
        f.write(text)
    want = [(i, k, v["code_string"]) for i, (k, v) in enumerate(json.loads(text, object_pairs_hook=OrderedDict).items())]
    got = [(r.ord, r.id, r.code_string) for r in RD.read_json_object(spark, p).orderBy("ord").collect()]
    assert got == want


def test_two_phase_rank_keeps_null_groups(spark):
    from labelbench.operators.rank import two_phase_row_number
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "g") for i in range(30)], "k long, g string")
    out = two_phase_row_number(df, ["g"], "k", F.floor(F.col("k") / 4), out="rn", total="n")
    rows = {(r.g, r.k): (r.rn, r.n) for r in out.collect()}
    assert len(rows) == 30
    nulls = sorted(k for g, k in rows if g is None)
    assert [rows[(None, k)][0] for k in nulls] == list(range(1, len(nulls) + 1))
    assert all(rows[(None, k)][1] == 10 for k in nulls)


def test_describe_matches_pandas(spark):
    import pandas as pd
    vals = {"train": [1, 2, 2, 5, 9, 10, 10, 11], "test": [3, 7, 8], "valid": [4]}
    rows = [(s, v) for s, vs in vals.items() for v in vs]
    df = spark.createDataFrame(rows, "split string, n_tokens int")
    got = {r.split: r for r in PR.describe_tokens(df).collect()}
    for s, vs in vals.items():
        want = pd.Series(vs, dtype=float).describe().round()
        r = got[s]
        assert r["count"] == int(want["count"])
        for ours, theirs in (("mean", "mean"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                             ("p75", "75%"), ("max", "max")):
            assert r[ours] == want[theirs], (s, ours)
        assert (r["std"] is None and pd.isna(want["std"])) or r["std"] == want["std"]


def test_dataset_stats_population_std(spark):
    import numpy as np
    vs = [3, 7, 8, 20]
    df = spark.createDataFrame([("train", v) for v in vs], "split string, n_tokens int")
    r = PR.dataset_stats(df).first()
    assert (r.num_samples, r.num_tokens_max, r.num_tokens_min) == (4, 20, 3)
    assert r.num_tokens_avg == pytest.approx(np.mean(vs)) and r.num_tokens_std == pytest.approx(np.std(vs))


def test_overlap_and_intersection_against_sets(spark):
    import random
    rng = random.Random(3)
    pool = [f"text {i}" for i in range(30)] + [None]
    rows = [(rng.choice(pool), rng.choice(["train", "train", "valid", "test"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "src string, split string")
    sets = {s: {t for t, sp in rows if sp == s} for s in ("train", "valid", "test")}
    got = {r.split: r.overlap for r in PR.split_overlap(df).collect()}
    assert got == {o: len(sets["train"] & sets[o]) for o in ("valid", "test")}
    inter = {r.src for r in PR.intersect_texts(df, "train", "test").collect()}
    assert inter == sets["train"] & sets["test"]


def test_class_distribution_against_pandas(spark):
    import collections
    import random
    import pandas as pd
    rng = random.Random(4)
    data = {s: [rng.choice("abcdef"[: 3 + i]) for _ in range(rng.randint(5, 40))]
            for i, s in enumerate(("train", "valid", "test"))}
    labels = sorted(set().union(*data.values()))
    table = pd.DataFrame(index=labels, columns=list(data), dtype=float)
    for s, ls in data.items():
        for k, v in collections.Counter(ls).items():
            table.loc[k, s] = v
    table = table.sort_values(by=["train", "valid", "test"], ascending=False)
    table.loc["Total"] = table.sum(axis=0)
    want = [(i, *[None if pd.isna(v) else int(v) for v in row]) for i, row in zip(table.index, table.values)]
    df = spark.createDataFrame([(lab, s) for s, ls in data.items() for lab in ls], "label string, split string")
    got = [tuple(r) for r in PR.class_distribution(df).collect()]
    assert got == want  # same rows in the same order


def test_class_token_stats_against_pandas(spark):
    import random
    import pandas as pd
    rng = random.Random(9)
    rows = [(rng.choice(["train", "valid", "test"]), rng.choice("xyz"), rng.randint(1, 60)) for _ in range(150)]
    df = spark.createDataFrame(rows, "split string, label string, n_tokens int")
    got = {(r.split, r.label): r for r in PR.describe_tokens_by_class(df).collect()}
    pdf = pd.DataFrame(rows, columns=["split", "label", "n"])
    for s in ("train", "valid", "test"):
        want = pdf[pdf.split == s].groupby("label")["n"].describe().round()
        for lab, w in want.iterrows():
            r = got[(s, lab)]
            assert r["count"] == int(w["count"])
            assert (r.mean, r["min"], r.p25, r.p50, r.p75, r["max"]) == \
                (w["mean"], w["min"], w["25%"], w["50%"], w["75%"], w["max"])
            assert (r.std is None and pd.isna(w["std"])) or r.std == w["std"]
