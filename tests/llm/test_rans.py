"""Round trips of the coder and of whole tables; damage is noticed."""
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import rans
from labelbench.llm.tokens import Encoder, vocabulary_path

ENC = Encoder(vocabulary_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300))
def test_frequencies(counts):
    f = rans.frequencies(np.array(counts), 10)
    assert f.sum() == 1024 and f.min() >= 1


def test_frequencies_of_many_rare_ids():
    f = rans.frequencies(np.concatenate([[10**9], np.ones(200_000, np.int64)]))
    assert f.sum() == 1 << rans.PROB and f.min() == 1
    with pytest.raises(ValueError):
        rans.frequencies(np.ones(5), 2)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 65536, 65537, 200_001])
def test_segment(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 50_256).astype(np.uint32)
    ids[0] = 50_256
    listed = [(None, 0, 1, True, True), (-5, 1, n - 1, True, False)]
    data = rans.encode(ids, listed)
    s = rans.Segment(data)
    assert np.array_equal(s.ids(), ids) and s.directory == listed
    for b in range(s.n_blocks):
        parts = np.concatenate([s.part(b, k) for k in range(s.checks)])
        assert np.array_equal(parts, ids[b * 65536:(b + 1) * 65536])
    if n == 200_001:
        p = np.unique(ids, return_counts=True)[1] / n
        assert len(data) * 8 < 1.06 * -(p * np.log2(p)).sum() * n + 40 * len(p)


def test_one_id():
    ids = np.zeros(100_000, np.uint32)
    data = rans.encode(ids, [(1, 0, 100_000, True, True)])
    assert np.array_equal(rans.Segment(data).ids(), ids)


def test_damage():
    ids = np.arange(70_000, dtype=np.uint32) % 999
    data = bytearray(rans.encode(ids, [(1, 0, 70_000, True, True)]))
    for at in (30, len(data) // 2, len(data) - 9):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(Exception):
            rans.Segment(bytes(bad)).ids()


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc_combine(a, b):
    assert rans.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("segment", [rans.SEGMENT, 1000, 7])
def test_table(spark, segment):
    r = random.Random(3)
    texts = [None, "", " \n", "one two", "ünï 日本", "w " * 3000] + ["".join(r.choice("ab c\n") for _ in range(r.randint(0, 300))) for _ in range(40 if segment > 7 else 4)]
    rows = [(i * 3 - 20, t, 0) for i, t in enumerate(texts if segment > 7 else texts[:4] + texts[6:])]
    rows += [rows[3], (rows[3][0], "another", 1), (None, "no id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    out = sorted(rans.round_trip(docs, segment=segment).collect(), key=lambda x: x.start)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [x.doc_id for x in out] == [w[0] for w in want]
    at = 0
    for x, (_, t, _) in zip(out, want):
        ids = np.array(ENC.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark):
    assert rans.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
