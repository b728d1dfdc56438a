"""S1-S3 on documents that are split: elements that cross splits, braces and quotes in strings, malformed documents."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from labelbench.sources import documents as DOC
from labelbench.sources import readers as RD

BITS = ['{', '}', '"', '\\', '\\"', '}"', '"}', '\\\\', '[', ']', ',', ':', 'ab', ' ', '\n', '\r\n', '\t', 'é', '😀', '{"x": 1}', '}, {']


def _text(rng, longest):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(longest)))


def _w(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(3))
def test_arrays_over_many_splits(spark, tmp_dir, small_splits, seed):
    rng = random.Random(seed)
    paths, want = [], []
    for i, ascii_only in enumerate((True, False)):
        rows = [None if rng.random() < 0.1 else {"func": _text(rng, 60), "target": rng.randrange(9), "more": {"a": [{"b": _text(rng, 9)}, {}]}}
                for _ in range(150)]
        rows[70] = {"func": _text(rng, 3000), "target": 1}  # longer than several splits
        paths.append(_w(tmp_dir, f"{i}.json", json.dumps(rows, ensure_ascii=ascii_only, indent=(None, 1)[i]) + "\n" * i))
        want += [(None, None) if r is None else (r["func"], r["target"]) for r in rows]
    assert spark.read.text(paths, lineSep="}").rdd.getNumPartitions() > 20
    got = RD.read_json_array(spark, paths, "struct<func:string,target:int>").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(300))
    assert [(r.func, r.target) for r in got] == want


def test_object_over_many_splits(spark, tmp_dir, small_splits):
    rng = random.Random(7)
    for end in ("", " \n"):
        parts = []
        for i in range(200):
            key = json.dumps(f"k{rng.randrange(150)}" + _text(rng, 3), ensure_ascii=False)
            value = None if rng.random() < 0.1 else {"code_string": _text(rng, 50), "err_obj": {"msg": _text(rng, 4)}}
            parts.append(f"{key}: {json.dumps(value)}")
        text = "{" + ", ".join(parts) + end + "}" + end
        want = [(i, k, v and v["code_string"], v and v["err_obj"]["msg"]) for i, (k, v) in enumerate(json.loads(text).items())]
        got = RD.read_json_object(spark, _w(tmp_dir, f"o{len(end)}.json", text)).orderBy("ord").collect()
        assert [(r.ord, r.id, r.code_string, r.err_obj and r.err_obj.msg) for r in got] == want


def test_sources_named_twice_and_empty_ones(spark, tmp_dir):
    a = _w(tmp_dir, "a.json", json.dumps([{"code": "x"}, {"code": "y}"}]))
    b = _w(tmp_dir, "b.json", " [ ] \n")
    c = _w(tmp_dir, "c.json", "")
    os.makedirs(os.path.join(tmp_dir, "none"))
    sources = [(a, "p"), (b, "q"), (os.path.join(tmp_dir, "none"), "r"), (c, "s"), (a, "t")]
    got = RD.read_labelled_sources(spark, sources).orderBy("ord").collect()
    assert [(r.ord, r.src, r.label) for r in got] == [(0, "x", "p"), (1, "y}", "p"), (2, "x", "t"), (3, "y}", "t")]
    assert RD.read_labelled_sources(spark, sources[2:3]).collect() == []
    with pytest.raises(FileNotFoundError):
        RD.read_json_array(spark, [a, os.path.join(tmp_dir, "missing.json")], "struct<code:string>")


@pytest.mark.parametrize("text", ['[{"code": "x"}', '[{"code": "x"} {"code": "y"}]', '[{"code": "x"}, ]', '{"code": "x"}',
                                  '[{"code": "x"}, {"code": "y', '[{"code": "x"}][{"code": "y"}]', '[{"code": "x"}] more'])
def test_malformed_arrays_are_errors(spark, tmp_dir, text):
    path = _w(tmp_dir, "bad.json", text)
    with pytest.raises(Exception):
        RD.read_json_array(spark, path, "struct<code:string>").select("code").collect()


@pytest.mark.parametrize("text", ['[{"a": 1}]', '{"a": {"code_string": "x"} "b": {"code_string": "y"}}',
                                  '{"a": {"code_string": "x"}}{"b": {"code_string": "y"}}', '{"a": {"code_string": "x', '{"a": {"code_string": "x"}'])
def test_malformed_objects_are_errors(spark, tmp_dir, text):
    path = _w(tmp_dir, "bad.json", text)
    with pytest.raises(Exception):
        RD.read_json_object(spark, path).select("id", "code_string").collect()


def test_no_task_takes_a_whole_file(spark, tmp_dir, small_splits):
    rows = [{"code": "{" * 40 + str(i)} for i in range(400)]
    path = _w(tmp_dir, "big.json", json.dumps(rows))
    pieces = DOC.read_pieces(spark, [path], "[")
    of_split = pieces.groupBy("file_start").agg(F.count("*").alias("n")).collect()
    assert len(of_split) > 30 and max(r.n for r in of_split) < 20
    assert pieces.count() == 401  # one element each, and what closes the array
