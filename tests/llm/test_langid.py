"""Language identification against a plain model, and held-out accuracy on the given table."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from labelbench.llm import langid
from labelbench.llm.tables import read

from conftest import SF01


def brute_grams(text):
    codes = [ord(c) for c in f" {text.lower()} "]
    out = Counter()
    for n in langid.ORDERS:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i:i + n]:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out[(h * 0x85EBCA77 & 0xFFFFFFFF) >> 17] += 1
    return out


def test_grams(monkeypatch):
    text = "Größe  ab\n" * 7
    whole = Counter(np.concatenate(list(langid.grams(text))).tolist())
    assert whole == brute_grams(text)
    monkeypatch.setattr(langid, "_STEP", 10)
    assert Counter(np.concatenate(list(langid.grams(text))).tolist()) == whole


def test_against_a_plain_model(spark):
    r = random.Random(3)
    words = {"x": "ab abc bca cab".split(), "y": "ud due edu deu".split()}
    rows = [(i, " ".join(r.choice(words[l]) for _ in range(6)), l, None) for i, l in enumerate("xyxxyxyxyy" * 3)]
    rows += [(100, None, "x", "s"), (101, "", "x", "s"), (102, "12 34 !", "y", "s"), (103, "ab abc", None, "s"), (None, "due", "x", "s"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    train = [(t, l) for i, t, l, _ in rows if t is not None and l and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]
    logp, prior = {}, {}
    for l in "xy":
        counts = sum((brute_grams(t) for t, k in train if k == l), Counter())
        total = sum(counts.values()) + langid.SMOOTHING * langid.BUCKETS
        logp[l] = lambda b, c=counts, t=total: math.log((c[b] + langid.SMOOTHING) / t)
        prior[l] = math.log(sum(k == l for _, k in train) / len(train))
    want = {}
    for i, t, _, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want[i] = ("und", 0.0)
            continue
        g = brute_grams(t)
        s = {l: (prior[l] + sum(n * logp[l](b) for b, n in g.items())) * min(1, langid.EVIDENCE / sum(g.values())) for l in "xy"}
        best = max(s, key=s.get)
        want[i] = (best, 1 / sum(math.exp(v - s[best]) for v in s.values()))
    for x in out:
        lang, score = want[x.doc_id]
        assert x.lang_pred == lang and abs(x.score - score) < 1e-9
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(i for i, *_ in rows if want[i][1] >= 0.5)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_many_languages(spark, monkeypatch):
    """No language is left out for being rare; beyond the bound of the matrix there is an error."""
    rows = [(8 * i + k, chr(0x4E00 + i) * 20, f"l{i:03d}") for i in range(300) for k in range(3 if i < 10 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = langid.fit(docs)
    train = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.languages) == train and len(train) > 200
    assert sum(p == lang for (p, _), (_, _, lang) in zip(model.predict([t for _, t, _ in rows]), rows) if lang in train) >= 0.9 * len(train)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 100)
    with pytest.raises(ValueError, match="more than 100 languages"):
        langid.fit(docs)


def test_batches_score_as_single_texts(monkeypatch):
    r = random.Random(8)
    model = langid.Model(["a", "b", "c"], np.array([3, 2, 1]), np.array([[r.randint(0, 9) for _ in range(langid.BUCKETS)] for _ in range(3)]))
    texts = ["".join(r.choice("abc déf") for _ in range(r.choice([0, 3, 40, 5000]))) for _ in range(60)] + [None, "", "12"]
    single = [model.predict([t])[0] for t in texts]
    monkeypatch.setattr(langid, "_CHUNK", 100)
    monkeypatch.setattr(langid, "_GRAMS", 3000)
    for (l, s), (m, z) in zip(model.predict(texts), single):
        assert l == m and abs(s - z) < 1e-9


def test_without_known_languages_texts_stay(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "ñ", None), (3, "12 !", None), (4, None, None), (5, "", None)], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in langid.keep_identified(docs).collect()) == [1, 2]


def test_held_out_accuracy(spark):
    docs = read(spark, SF01, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right, sure = out.selectExpr("count(*)", "sum(int(lang = lang_pred))", "sum(int(score >= 0.5))").first()
    assert n > 200 and right >= 0.97 * n and sure >= 0.99 * n
