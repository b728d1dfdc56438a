"""S1-S7, S9 and K1-K8 on small files written by the tests."""
import json
import os

import pytest
from pyspark.sql import functions as F

from labelbench.sources import readers as RD
from labelbench.sources import sinks as SK


def _w(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_json_array_positions(spark, tmp_dir):
    p = _w(os.path.join(tmp_dir, "function.json"),
           json.dumps([{"func": "int a;", "target": 1, "x": 0}, {"func": "b", "target": 0}, {"func": "c", "target": 1}]))
    df = RD.read_json_array(spark, p, "struct<func:string,target:int>")
    assert [(r.ord, r.func, r.target) for r in df.orderBy("ord").collect()] == [(0, "int a;", 1), (1, "b", 0), (2, "c", 1)]


def test_labelled_sources_order(spark, tmp_dir):
    a = _w(os.path.join(tmp_dir, "vulnerables.json"), json.dumps([{"code": "v1"}, {"code": "v2"}]))
    b = _w(os.path.join(tmp_dir, "non-vulnerables.json"), json.dumps([{"code": "n1"}]))
    df = RD.read_labelled_sources(spark, [(a, "vulnerable"), (b, "non-vulnerable")])
    assert [(r.ord, r.src, r.label) for r in df.orderBy("ord").collect()] == [
        (0, "v1", "vulnerable"), (1, "v2", "vulnerable"), (2, "n1", "non-vulnerable")]


def test_json_object_order_and_labels(spark, tmp_dir):
    obj = ('{"k2": {"code_string": "x", "err_obj": {"msg": "unexpected indent"}},'
           ' "k1": {"code_string": "y", "err_obj": {"msg": "invalid syntax"}}}')
    p = _w(os.path.join(tmp_dir, "orig.bad.json"), obj)
    df = RD.bifi_labels(RD.read_json_object(spark, p))
    assert [(r.ord, r.id, r.label) for r in df.orderBy("ord").collect()] == [
        (0, "k2", "indentation error"), (1, "k1", "invalid syntax")]
    bad = _w(os.path.join(tmp_dir, "bad.json"), '{"k": {"code_string": "x", "err_obj": {"msg": "new message"}}}')
    with pytest.raises(Exception, match="unknown label"):
        RD.bifi_labels(RD.read_json_object(spark, bad)).collect()


def test_index_list(spark, tmp_dir):
    p = _w(os.path.join(tmp_dir, "train.txt"), "3\n 5 \n3\n\t7\n")
    assert sorted(r.ord for r in RD.read_index_list(spark, p).collect()) == [3, 5, 7]
    blank = _w(os.path.join(tmp_dir, "valid.txt"), "3\n\n5\n")
    with pytest.raises(Exception):
        RD.read_index_list(spark, blank).collect()


def test_jsonl_shards_in_order(spark, tmp_dir):
    paths = RD.shard_paths(tmp_dir, "exception", "dev", 4)
    contents = [[("a", "E1"), ("b", "E2")], [], [("c", "E1")], [("d", "E3")]]
    for p, rows in zip(paths, contents):
        _w(p, "".join(json.dumps({"function": f, "label": lab}) + "\n" for f, lab in rows))
    df = RD.read_jsonl_shards(spark, paths, "dev")
    assert [(r.ord, r.src, r.split) for r in df.orderBy("ord").collect()] == [
        (0, "a", "valid"), (1, "b", "valid"), (2, "c", "valid"), (3, "d", "valid")]
    counts = {r.shard: r.n for r in RD.shard_counts(spark, paths).collect()}
    assert counts == {0: 2, 2: 1, 3: 1}
    with pytest.raises(Exception, match="unknown split name"):
        RD.read_jsonl_shards(spark, paths, "holdout").collect()


def test_jsonl_int_labels_and_paired_text(spark, tmp_dir):
    p = _w(os.path.join(tmp_dir, "train.jsonl"), '{"src": "x", "label": 1}\n{"src": "y", "label": 0}\n')
    assert [(r.ord, r.label) for r in RD.read_jsonl(spark, p, "int").orderBy("ord").collect()] == [(0, 1), (1, 0)]
    a = _w(os.path.join(tmp_dir, "corpus.txt"), " def f():\t\nreturn 1\n")
    b = _w(os.path.join(tmp_dir, "labels.txt"), "A\nB \n")
    got = [(r.ord, r.src, r.label) for r in RD.read_paired_text(spark, a, b).orderBy("ord").collect()]
    assert got == [(0, "def f():", "A"), (1, "return 1", "B")]
    c = _w(os.path.join(tmp_dir, "labels3.txt"), "A\nB\nC\n")
    with pytest.raises(Exception, match="differ in length"):
        RD.read_paired_text(spark, a, c).collect()


def test_runs_csv(spark, tmp_dir):
    header = ("params.combination_type,params.hidden_layer_to_use,params.seed,params.epochs,"
              "params.not_special_tokens_to_zero,start_time,end_time,metrics.acc_test\n")
    p = _w(os.path.join(tmp_dir, "mlflow_devign.csv"),
           header + "one_layer_cls,12,1,10,False,2023-01-31 23:00:00.5+00:00,2023-02-01 01:00:00+00:00,0.61\n"
                    "one_layer_cls,12,1,10,False,2023-01-01 00:00:00,2023-01-01 00:10:00,\n")
    df = RD.read_runs_csv(spark, [p])
    rows = df.orderBy("ord").collect()
    assert [r.dataset for r in rows] == ["devign", "devign"] and rows[1].acc_test is None
    assert rows[0].not_special_tokens_to_zero is False and rows[0].hidden_layer_to_use == 12


def test_append_and_upsert(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tbl")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    SK.append_distinct(a, path)
    out = SK.append_distinct(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"), path)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x"), (2, "y"), (3, "z")]
    up = os.path.join(tmp_dir, "kv")
    SK.upsert_by_key(a, up, "k")
    got = SK.upsert_by_key(spark.createDataFrame([(2, None), (4, "w")], "k int, v string"), up, "k")
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "x"), (2, None), (4, "w")]
    # every version is kept; the reader takes the latest complete one
    assert sorted(os.listdir(up)) == ["v=000001", "v=000002"]


def test_split_jsonl_and_metric_log(spark, tmp_dir):
    df = spark.createDataFrame([("a", "x", "train"), ("b", "y", "test")], "src string, label string, split string")
    SK.write_split_jsonl(df, os.path.join(tmp_dir, "out"))
    assert sorted(os.listdir(os.path.join(tmp_dir, "out")))[-2:] == ["split=test", "split=train"]
    log = spark.createDataFrame([(1, "loss", 0.5, 10)], "run_id int, metric string, value double, step int")
    lp = os.path.join(tmp_dir, "log")
    SK.log_metrics(log, lp)
    SK.log_metrics(log, lp)
    assert SK.read_metric_log(spark, lp).count() == 1
    hist = spark.createDataFrame([(-1, [0.1, 0.2]), (0, [0.3, 0.4]), (0, [0.3, 0.4])], "epoch int, weights array<double>")
    wide = SK.write_weight_history(hist, os.path.join(tmp_dir, "w"), 2)
    assert sorted(wide.columns) == ["0", "1", "epoch"] and wide.count() == 2


def test_incomplete_version_is_ignored(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tbl2")
    SK.append_distinct(spark.createDataFrame([(1, "x")], "k int, v string"), path)
    # a job that died half way: a version folder without _SUCCESS
    os.makedirs(os.path.join(path, "v=000002"))
    with open(os.path.join(path, "v=000002", "part-0.parquet"), "wb") as f:
        f.write(b"garbage")
    assert sorted(tuple(r) for r in SK.read_appended(spark, path).collect()) == [(1, "x")]
    out = SK.append_distinct(spark.createDataFrame([(2, "y")], "k int, v string"), path)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x"), (2, "y")]


def _put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_runs_csv_keeps_all_rows_and_columns(spark, tmp_dir):
    p = os.path.join(tmp_dir, "mlflow_x.csv")
    head = "params.seed,metrics.acc_test,tags.note\n"
    _put(p, "part-0.csv", head + '1,0.5,plain\n2,0.25,"a, ""b"""\n')
    _put(p, "part-1.csv", "3,0.75,headless part\n4,,\n")
    _put(p, "part-2.csv", head + "5,1.0,last\n")
    got = RD.read_runs_csv(spark, [p]).orderBy("ord").collect()
    assert [(r.dataset, r.ord, r.seed, r.acc_test, r.tags_note) for r in got] == [
        ("x", 0, 1, 0.5, "plain"), ("x", 1, 2, 0.25, 'a, "b"'), ("x", 2, 3, 0.75, "headless part"), ("x", 3, 4, None, None),
        ("x", 4, 5, 1.0, "last")]
    q = os.path.join(tmp_dir, "mlflow_y.csv")
    _put(q, "a.csv", 'params.seed,tags.note\n7,"two\nlines"\n8,one\n')
    two = RD.read_runs_csv(spark, [p, q], multi_line=True).where("dataset = 'y'").orderBy("ord").collect()
    assert [(r.ord, r.seed, r.tags_note, r.acc_test) for r in two] == [(0, 7, "two\nlines", None), (1, 8, "one", None)]


def test_runs_csv_raises_on_bad_values(spark, tmp_dir):
    p = os.path.join(tmp_dir, "mlflow_z.csv")
    _put(p, "a.csv", "params.seed,metrics.acc_test\nnotanint,0.5\n")
    with pytest.raises(Exception, match="not a int"):
        RD.read_runs_csv(spark, [p]).collect()


def test_one_large_file_is_read_in_splits(spark, tmp_dir):
    n = 40_000
    _put(tmp_dir, "big.jsonl", "".join('{"src": "line %d", "label": "l"}\n%s' % (i, "\n" if i % 1000 == 0 else "") for i in range(n)))
    _put(tmp_dir, "corpus.txt", "".join(f" t{i} \r\n" for i in range(n)))
    _put(tmp_dir, "labels.txt", "".join(f"{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        lines, _ = RD._lines(spark, os.path.join(tmp_dir, "big.jsonl"))
        assert lines.rdd.getNumPartitions() > 3
        got = RD.read_jsonl(spark, os.path.join(tmp_dir, "big.jsonl")).selectExpr("count(*)", "sum(int(src = concat('line ', ord)))").first()
        assert tuple(got) == (n, n)
        pair = RD.read_paired_text(spark, os.path.join(tmp_dir, "corpus.txt"), os.path.join(tmp_dir, "labels.txt"))
        assert tuple(pair.selectExpr("count(*)", "sum(int(src = concat('t', ord) and label = string(ord)))").first()) == (n, n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_positions_hold_when_later_scans_split_otherwise(spark, tmp_dir):
    """Settings (or cores) that change between planning and running leave every row and its position."""
    n = 20_000
    folder = os.path.join(tmp_dir, "a b")
    os.mkdir(folder)
    for k in range(3):
        _put(folder, f"part-{k}.jsonl", "".join('{"src": "line %d", "label": "l"}\n' % i for i in range(k * n, (k + 1) * n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70k")
        rows = RD.read_jsonl(spark, [folder])
        shards = RD.read_jsonl_shards(spark, [os.path.join(folder, f"part-{k}.jsonl") for k in (2, 0)], "dev", "src")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        assert tuple(rows.selectExpr("count(*)", "sum(int(src = concat('line ', ord)))", "count(distinct ord)").first()) == (3 * n,) * 3
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        got = shards.selectExpr("count(*)", "sum(int(src = concat('line ', if(ord < 20000, ord + 40000, ord - 20000))))", "min(split)").first()
        assert tuple(got) == (2 * n, 2 * n, "valid")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_upsert_of_a_key_given_twice(spark, tmp_dir):
    path = os.path.join(tmp_dir, "kv2")
    ddl = "k string, v int, t int"
    rows = spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("l", 3, 1), (None, 4, 1), ("n", None, 2), ("n", 9, 1)], ddl).repartition(4)
    got = SK.upsert_by_key(rows, path, "k", order_col="t")
    assert sorted(((r.k, r.v) for r in got.collect()), key=repr) == [("k", 2), ("l", 3), ("n", None), (None, 4)]
    same = spark.createDataFrame([("k", 7, 5), ("k", 7, 5)], ddl)
    assert {r.k: r.v for r in SK.upsert_by_key(same, path, "k").collect()}["k"] == 7
    for order in (None, "t"):
        with pytest.raises(Exception, match="several values for the key l"):
            SK.upsert_by_key(spark.createDataFrame([("l", 1, 5), ("l", 2, 5)], ddl), path, "k", order_col=order).collect()
    assert {r.k: r.v for r in SK.read_upserted(spark, path, "k").collect()} == {"k": 7, "l": 3, "n": None, None: 4}


def test_metric_log_takes_the_last_call(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    ddl = "run_id int, metric string, value double, step long"
    SK.log_metrics(spark.createDataFrame([(1, "acc", 0.5, 1), (1, "acc", 0.6, 2)], ddl), path)
    SK.log_metrics(spark.createDataFrame([(1, "acc", 0.7, 1)], ddl), path)
    assert {(r.step, r.value) for r in SK.read_metric_log(spark, path).collect()} == {(1, 0.7), (2, 0.6)}
    SK.log_metrics(spark.createDataFrame([(1, "acc", 0.1, 3), (1, "acc", 0.2, 3)], ddl), path)
    with pytest.raises(Exception, match="two values"):
        SK.read_metric_log(spark, path).collect()


def test_appends_write_only_new_rows(spark, tmp_dir):
    path = os.path.join(tmp_dir, "app")
    SK.append_distinct(spark.createDataFrame([(1, None), (2, "y")], "k int, v string"), path)
    SK.append_distinct(spark.createDataFrame([(1, None), (3, "z")], "k int, v string"), path)
    assert [tuple(r) for r in spark.read.parquet(f"{path}/v=000002").collect()] == [(3, "z")]


def _spoil(folder):
    """Overwrites the rows of a version; the footers with the schema stay."""
    for name in os.listdir(folder):
        if name.endswith(".crc"):
            os.remove(os.path.join(folder, name))
        elif name.endswith(".parquet"):
            with open(os.path.join(folder, name), "r+b") as f:
                f.seek(4)
                f.write(b"\xff" * 12)


def test_append_reads_only_versions_that_may_hold_its_rows(spark, tmp_dir):
    path, ddl = os.path.join(tmp_dir, "held"), "k int, x double, v string"
    batch = lambda lo, hi: spark.createDataFrame([(i, i / 2, f"v{i}" * 20) for i in range(lo, hi)], ddl)
    for lo in (0, 100, 200):
        SK.append_distinct(batch(lo, lo + 100), path)
    assert SK.versions_that_may_hold(batch(300, 400), path) == []
    assert SK.versions_that_may_hold(batch(150, 160), path) == ["v=000002"]
    assert SK.versions_that_may_hold(batch(199, 201), path) == ["v=000002", "v=000003"]
    _spoil(f"{path}/v=000001")
    with pytest.raises(Exception):
        SK.read_appended(spark, path).collect()
    SK.append_distinct(batch(250, 350), path)  # reads version 3 alone
    assert sorted(r.k for r in spark.read.parquet(f"{path}/v=000004").collect()) == list(range(300, 350))


def test_append_hashes_agree_with_equality(spark, tmp_dir):
    """NULLs, signed zeros, NaN, columns in another order, missing, new or of another type, nested values, a version without hashes."""
    path, nan = os.path.join(tmp_dir, "alike"), float("nan")
    first = spark.createDataFrame([(1, 0.0, ["a", None]), (2, nan, None), (None, None, [])], "k int, x double, a array<string>")
    SK.append_distinct(first, path)
    again = spark.createDataFrame([(["a", None], -0.0, 1), (None, nan, 2), ([], None, None)], "a array<string>, x double, k int")
    assert SK.append_distinct(again, path).count() == 3
    assert SK.append_distinct(again.withColumn("more", F.lit(None).cast("string")), path).count() == 3
    assert SK.append_distinct(spark.createDataFrame([(2, nan)], "k int, x double"), path).count() == 3
    assert SK.append_distinct(first.withColumn("more", F.lit("m")), path).count() == 6
    other = os.path.join(tmp_dir, "wider")
    SK.append_distinct(spark.createDataFrame([(1,), (2,)], "k int"), other)
    with pytest.raises(TypeError):
        SK.append_distinct(spark.createDataFrame([(1,), (2,)], "k long"), other)
    assert SK.read_appended(spark, other).count() == 2
    plain = os.path.join(tmp_dir, "plain")
    spark.createDataFrame([(1, "x")], "k int, v string").write.parquet(f"{plain}/v=000001")
    assert SK.append_distinct(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), plain).count() == 2


def test_appends_are_compacted(spark, tmp_dir):
    path = os.path.join(tmp_dir, "many")
    for i in range(6):
        SK.append_distinct(spark.createDataFrame([(i, "x"), (i + 1, "x")], "k int, v string"), path, compact_after=3)
    assert "c=000004-000000" in os.listdir(path) and len(SK._versions(spark, path)) == 3
    for name in ("v=000001", "v=000004"):  # nothing below the compacted folder is read any more
        _spoil(f"{path}/{name}")
    assert sorted(r.k for r in SK.read_appended(spark, path).collect()) == list(range(7))
    os.makedirs(f"{path}/c=000006-000000")  # a compaction that died
    SK.append_distinct(spark.createDataFrame([(2, "x"), (9, "x")], "k int, v string"), path, compact_after=3)
    assert sorted(r.k for r in SK.read_appended(spark, path).collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
    assert SK.versions_that_may_hold(spark.createDataFrame([(3, "x")], "k int, v string"), path) == ["c=000007-000000"]
    up = os.path.join(tmp_dir, "kv2")
    for i in range(3):
        SK.upsert_by_key(spark.createDataFrame([(1, i), (i + 5, i)], "k int, v int"), up, "k")
    SK.compact_versions(SK.read_upserted(spark, up, "k"), up)
    got = SK.upsert_by_key(spark.createDataFrame([(5, 9)], "k int, v int"), up, "k")
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, 2), (5, 9), (6, 1), (7, 2)]
