"""Ids against the tokenizer itself; packing against its rules."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import packing, tokens
from labelbench.llm.tokens import Encoder, vocabulary_path

PATH = vocabulary_path()
ENC = Encoder(PATH, memo_words=50)
TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "\na", "a\n", "a \n b", "a\n\nb", "don't, I'm it's.", "x y 　z",
         "naïve café: Übergröße! ñandú?", "tab\tb c", "a<|endoftext|>b c", "日本語 テキスト 12 3,4", "a  b", "ok. \x1c b", "é f", "ªº µ",
         "one two\nthree four\nfive", ". , !", "a,b c.. d?! e", "it' it'' 's don't'", "end!! $$$ x%%% y&& (z) [q]_ `a` it's' a'll"]


def _doc_rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string")


def test_ids_of_cases():
    for t in TEXTS * 2:
        assert ENC.ids(t).tolist() == ENC.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def _batch(texts, encoder=ENC):
    ids, ends = encoder.batch(pa.array(texts, pa.string()))
    assert len(ends) == len(texts) + 1 and ends[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_batches_of_cases(monkeypatch):
    want = [ENC.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert _batch(TEXTS) == want and _batch([]) == [] and _batch([None, "a b", None]) == [[], ENC.ids("a b").tolist(), []]
    monkeypatch.setattr(tokens, "SLICE", 20)
    assert _batch([*TEXTS, *TEXTS], Encoder(PATH, memo_words=5)) == want * 2
    assert _batch(pa.array([*TEXTS, "x"]).slice(3, 9).to_pylist()) == want[3:12]
    ids, ends = ENC.batch(pa.array(TEXTS, pa.string()).slice(5, 6))  # an array with an offset
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[5:11]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t.,'abcDé ñ1 <|>!?-ª")), max_size=40), max_size=8))
def test_batches_of_random_texts(texts):
    assert _batch(texts) == [ENC.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t.,'abcDé ñ1 <|>!?-ª")), max_size=40))
def test_ids_of_random_texts(t):
    assert ENC.ids(t).tolist() == ENC.tokenizer.encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80), st.integers(1, 5))
def test_bins_against_a_scan(lengths, limit):
    bins, free, nxt = packing.OpenBins(16, limit), {}, 0
    for n in lengths:
        fits = [f for f in free.values() if f >= n]
        bins_before = {f: list(b) for f, b in enumerate(bins.by_free)}
        got, offset = bins.place(n)
        if fits:
            assert free[got] == min(fits)
        else:
            assert got == nxt
            nxt += 1
            free[got] = 16
        assert offset == 16 - free[got]
        free[got] -= n
        if free[got] == 0:
            del free[got]
        elif len(free) > limit:
            fullest = min(free.values())
            closed = got if free[got] == fullest else next(iter(bins_before[fullest]))
            del free[closed]


def test_pack(spark):
    texts = TEXTS + [None, "many words here " * 700, "rep", "rep"]
    rows = packing.pack(_doc_rows(spark, texts), capacity=64, open_bins=3).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(ENC.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids)
        assert len(pieces) == 1 if len(ids) <= 64 else all(r.length == 64 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_nothing(spark):
    assert packing.pack(_doc_rows(spark, ["x"]).limit(0)).count() == 0


def test_memo_keeps_no_long_words():
    """A memo is bounded by words, so a word of any length may not stay in it."""
    enc = Encoder(PATH, memo_words=50)
    text = "short " + "x" * 1000 + " " + "q" * 1000 + ",\n" + "y" * 1000
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*enc.inside, *enc.leading])) <= tokens.MEMO_LETTERS and "short" in enc.leading


def test_pack_in_batches_of_any_size(spark):
    """Small Arrow batches, which bound a worker's memory, place the pieces as large ones do."""
    r = random.Random(5)
    docs = _doc_rows(spark, ["word " * r.randint(0, 90) for _ in range(400)]).coalesce(1).cache()
    size, got = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(size)
    try:
        for n in ("10000", "7"):
            spark.conf.set(size, n)
            got.append(sorted(map(tuple, packing.pack(docs, capacity=64, open_bins=3).collect())))
    finally:
        spark.conf.set(size, before)
    assert len(got[0]) > 400 and got[0] == got[1]
