"""X6 and P3 on a file-source stream (availableNow)."""
import json
import os

from labelbench.streaming.normalize import run_available


def test_stream_normalises_new_files(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps({"src": " a\t\tb\r\n c  ", "label": "unexpected indent"}) + "\n")
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    run_available(spark, src, "src string, label string", out, ck, src_col="src", label_col="label")
    rows = spark.read.parquet(out).collect()
    assert [(r.src, r.label) for r in rows] == [("a b c", "indentation error")]
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps({"src": "x   y", "label": "invalid syntax"}) + "\n")
    run_available(spark, src, "src string, label string", out, ck, src_col="src", label_col="label")
    assert sorted(r.src for r in spark.read.parquet(out).collect()) == ["a b c", "x y"]
