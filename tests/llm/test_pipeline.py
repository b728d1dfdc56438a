"""The pipeline against its stages done by brute force, on a made table and on the given one."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zlib

import corpus_pipeline
from labelbench.llm import langid, simhash
from labelbench.llm.tables import cut_lineage, read
from labelbench.llm.tokens import Encoder, vocabulary_path

from conftest import SF001
from test_simhash import brute_components, brute_fingerprint
from test_substrings import brute


def _staged(spark, docs, sf_dir=None):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(cut_lineage(f(spark, out[-1], sf_dir)))
    return out


def _key(x):
    return (x.doc_id, x.text, x.lang, x.source)


def _check(stages):
    rows = [s.collect() for s in stages[:5]]
    names = stages[0].columns
    assert all(s.columns == names for s in stages[1:5])
    # language: whole rows stay, all with a letter
    assert not Counter(map(_key, rows[1])) - Counter(map(_key, rows[0]))
    gone = Counter(map(_key, rows[0])) - Counter(map(_key, rows[1]))
    assert all(not any(c.isalpha() for c in k[1] or "") or len(k[1]) < 40 for k in gone)
    # near duplicates: the head of every component
    ids = [(x.doc_id, brute_fingerprint(x.text)) for x in rows[1]]
    linked = [(a, b) for a, f in ids for b, g in ids if a < b and (f ^ g).bit_count() <= 3]
    comp = brute_components({i for i, _ in ids}, linked)
    assert sorted(x.doc_id for x in rows[2]) == sorted(set(comp.values()))
    # substrings
    want = brute([(x.doc_id, x.text) for x in rows[2]], 20)
    assert {x.doc_id for x in rows[3]} == {x.doc_id for x, (n, r, _) in zip(rows[2], want) if r < n or not n}
    lost = {x.doc_id: r for x, (n, r, _) in zip(rows[2], want)}
    before = {x.doc_id: x.text for x in rows[2]}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for x in rows[3]:
        assert x.text == before[x.doc_id] if not lost[x.doc_id] else len(split(before[x.doc_id])) - len(split(x.text)) == lost[x.doc_id]
    # mixing: every document, some again
    assert set(map(_key, rows[4])) == set(map(_key, rows[3]))
    # packing: the ids of every row
    enc = Encoder(vocabulary_path())
    packed = stages[5].collect()
    n_tokens = Counter()
    for x in rows[4]:
        n_tokens[x.doc_id] += len(enc.ids(x.text)) + 1
    got = Counter()
    bins = defaultdict(int)
    for p in packed:
        got[p.doc_id] += p.length
        bins[p.sequence_id] += p.length
    assert got == n_tokens and max(bins.values()) <= 1024


def test_made_table(spark):
    r = random.Random(9)
    vocab = {"aa": "lorem ipsum dolor sit amet elit sed do".split(), "bb": "ka zu wo pi rik tok mun".split()}
    prose = lambda l, n: " ".join(r.choice(vocab[l]) + r.choice(["", "x", "yy", "zzz"]) for _ in range(n))
    passage = prose("aa", 40)
    rows = []
    for i in range(120):
        l = "aa" if i % 3 else "bb"
        t = prose(l, r.randint(30, 200))
        rows.append((i, t + (" " + passage if i % 10 == 1 else ""), l, "src%d" % (i % 7 % 3)))
    rows += [(200 + i, rows[i][1] + (" end" if i % 2 else ""), rows[i][2], "src0") for i in range(30)]
    rows += [(300, None, "aa", "src0"), (301, "", None, None), (302, "1234 ...", "bb", "src1"), (303, prose("aa", 50), None, None), rows[5]]
    _check(_staged(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)))


def test_given_table(spark):
    _check(_staged(spark, read(spark, SF001, "documents"), SF001))


def test_run_counts_as_the_stages(spark):
    out = corpus_pipeline.run(spark, SF001).collect()
    assert sum(p.length for p in out) == sum(p.length for p in _staged(spark, read(spark, SF001, "documents"), SF001)[-1].collect())


def test_texts_go_to_python_in_bounded_batches(spark, monkeypatch):
    """Whatever a stage's operator sends to the Python workers, when its result is written, comes in batches of BATCH_BYTES."""
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('some words ', 600) text").coalesce(1)  # 26 MB

    def sizes(docs, **_):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]}) for b in batches),
                               "bytes long, rows long")

    for module, operator in ((corpus_pipeline.langid, "keep_identified"), (corpus_pipeline.simhash, "keep_one"), (corpus_pipeline.substrings, "remove"),
                             (corpus_pipeline.mixing, "mix"), (corpus_pipeline.packing, "pack")):
        monkeypatch.setattr(module, operator, sizes)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        got = stage(spark, docs, None).collect()
        assert sum(x.rows for x in got) == 4000 and max(x.bytes for x in got) < 1.1 * corpus_pipeline.BATCH_BYTES
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
