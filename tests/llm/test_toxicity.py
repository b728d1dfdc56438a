"""Windows, features and scores against plain forms; held-out accuracy on made documents."""
import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import zstandard as zs
from pyspark.sql import functions as F

from labelbench.llm import toxicity


def test_windows_cover_the_text():
    text = "A b\tC\n" * 50 + "end"
    assert b" ".join(w.strip() for w in toxicity.windows(text, 4)).split() == text.lower().encode().split()
    assert toxicity.windows(None) == toxicity.windows(" ") == [b"  "]


def test_logistic_finds_the_separating_direction():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 2))
    y = (r.random(2000) < 1 / (1 + np.exp(-(1.0 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(toxicity.logistic(x, y) - [1, 2, -1]).max() < 0.35


def _docs(spark, n=600, long=1):
    r = random.Random(7)
    syllables = "ba co di fu ga he ji ko lu ma ne po ri su ta ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rude = [w * long for w in ("grumblewort", "snotface", "dunderhead", "wretchling")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [word() for _ in range(r.randint(60, 200))]
        if toxic:
            for _ in range(r.randint(4, 8)):
                words.insert(r.randint(0, len(words)), r.choice(rude))
        rows.append((i, " ".join(words), "z"))
        labels.append((i, int(toxic)))
    rows += [(n, None, "z"), (n + 1, "", "z"), (None, "dunderhead", "z"), rows[0]]
    labels += [(n, 0), (None, 1), (3, None), (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), n


def test_classify(spark):
    docs, labels, n = _docs(spark)
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == n + 4
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)
    held = [x for x in out if x.held_out and x.doc_id < n]
    assert len(held) > 100
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.95 * len(held)
    assert len({x.score for x in out if x.doc_id == 0}) == 1


def test_long_words_count(spark):
    docs, labels, n = _docs(spark, 400, long=12)  # words of 96 to 132 characters
    held = [x for x in toxicity.classify(docs, labels).collect() if x.held_out and x.doc_id < n]
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.95 * len(held)


def test_dictionary_words_and_scores_in_plain_python(spark):
    """Supports and lifts counted by hand; gains from zstandard itself; the score from the weights."""
    docs, labels, n = _docs(spark, 200)
    rows = docs.where("doc_id < 200 and text is not null").dropDuplicates(["doc_id"]).join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    rows = rows.select("doc_id", "text", "toxic").collect()
    contexts = {0: defaultdict(set), 1: defaultdict(set)}
    for x in rows:
        words = x.text.lower().split()
        for before, w in zip(["", *words], words):
            contexts[x.toxic][w].add(before)
    n1 = sum(x.toxic for x in rows)
    n0 = len(rows) - n1
    least = max(toxicity.LEAST_CONTEXTS, toxicity.SUPPORT * n1)
    strong = [(-len(c), w) for w, c in contexts[1].items() if len(c) >= least and len(c) / n1 >= toxicity.LIFT * (len(contexts[0][w]) + 0.5) / n0]
    sample = spark.createDataFrame(rows)
    assert toxicity._dictionary_words(sample, n1, n0) == [w for _, w in sorted(strong)][::-1] and len(strong) >= 4

    model = toxicity.fit(docs, labels)
    ordinary, toxic = (zs.ZstdCompressionDict(c, dict_type=zs.DICT_TYPE_RAWCONTENT) for c in model.compressors.contents)

    def size(data, d):
        return len(zs.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False).compress(data))

    for text in [rows[0].text, rows[3].text, "snotface", "", None, "a b c d e f g h i j"]:
        words = (text or "").lower().split()
        parts = [f" {' '.join(words[i:i + toxicity.WINDOW])} ".encode() for i in range(0, len(words), toxicity.WINDOW)] or [b"  "]
        gain = [size(w, ordinary) - size(w, toxic) for w in parts]
        x = [min(max(gain), 20)] + [math.log1p(sum(g >= t for g in gain)) for t in toxicity.THRESHOLDS] + [math.log(len(gain))]
        z = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x))
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_a_very_long_text_in_the_sample(spark):
    """Counting is linear in a text's length."""
    docs, labels, n = _docs(spark, 100)
    r = random.Random(1)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(150_000))
    more = spark.createDataFrame([(1000, long, "z"), (1001, long[::-1], "z"), (1004, long + "x", "z")], docs.schema)
    began = time.time()
    toxicity.fit(docs.unionByName(more), labels.unionByName(spark.createDataFrame([(1000, 0), (1001, 0), (1004, 0)], labels.schema)))
    assert time.time() - began < 60


def test_held_out_labels_are_not_read(spark):
    docs, labels, n = _docs(spark, 300)
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a, b = (sorted(map(tuple, toxicity.classify(docs, l).collect()), key=str) for l in (labels, other))
    assert a == b


def test_without_labels(spark):
    docs, labels, n = _docs(spark, 20)
    assert {x.score for x in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
