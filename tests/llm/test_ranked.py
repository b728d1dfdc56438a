"""Ranked search against scoring every document, and its lists, windows and shards against plain sums."""
import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import ranked
from labelbench.llm.tables import read

from conftest import SF001

TERM = re.compile(ranked.TERM)


def words(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    """{(item_id, rank, doc_id, score)} by scoring all documents."""
    found = [(i, Counter(words(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c in found:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    text = "Ab_c-ÄÖ é1 \x00x\x7fy\t\nÉ 日本 KK [z]{9} ~`@"  # the Kelvin sign is not lower-cased
    assert [t.decode() for t in ranked.terms(text)] == words(text)
    assert ranked.terms(None) == ranked.terms("") == ranked.terms("-- \n") == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 6), st.sampled_from([1, 3, 16, 64]), st.sampled_from([1, 4, 32]))
def test_top_of_a_shard(seed, n, k, window, short):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 6, n)
    terms = np.concatenate([r.choice(8, s, replace=False, p=[.5, .2, .1, .1, .04, .03, .02, .01]) if s else np.empty(0, int) for s in sizes]).astype(np.int64)
    tfs, lengths = r.integers(1, 4, len(terms)), r.integers(1, 9, n) * 5
    ids = r.permutation(n) // 2  # some twice
    weights = r.integers(0, 4, 8) * 1000
    lists = ranked.Lists(ids, lengths, sizes, terms, tfs, weights, 1000, 25_000)
    query = np.flatnonzero(r.random(8) < 0.6)
    m = 10 + 90 * lengths * 1000 // 25_000
    doc = np.repeat(np.arange(n), sizes)
    scores = np.zeros(n, np.int64)
    for d, t, f in zip(doc, terms, tfs):
        if t in query:
            scores[d] += weights[t] * (10**9 * f // (1000 * f + 8 * m[d]))
    want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if s > 0)[:k]
    assert sorted((-s, d) for s, d in ranked.top(lists, query, k, window=window, short=short)) == want
    if want:  # a threshold from elsewhere keeps what equals it
        least = -want[len(want) // 2][0]
        kept = ranked.top(lists, query, k, least, window=window, short=short)
        assert sorted((-s, d) for s, d in kept) == [x for x in want if -x[0] >= least]


def _made():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(r.expovariate(0.1)))].upper() if r.random() < 0.2 else vocabulary[min(59, int(r.expovariate(0.1)))] for _ in range(n))
    docs = [(i, text(r.randint(1, 60))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(None, docs[3][1]), (None, None), (2000, ""), (2001, None), (2002, " - \n"), (5, docs[7][1]), (5, docs[7][1]), (3000, text(40_000))]
    items = [(i, text(r.randint(1, 12))) for i in range(25)] + [(90, None), (91, "??"), (92, "nowhere"), (None, "w1 w2"), (3, "w50 w51"), (95, docs[3][1])]
    return docs, items


def test_rows(spark):
    docs, items = _made()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, item_id int").repartition(5)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    assert rows(ranked.search(d, q)) == brute(docs, items)
    # small shards, and the items in several blocks
    assert rows(ranked.search(d, q, shard=500, block=60)) == brute(docs, items)
    assert rows(ranked.search(d, q, k=1)) == brute(docs, items, 1)


def test_empty_tables(spark):
    docs, items = _made()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(d.limit(0), q).count() == ranked.search(d, q.limit(0)).count() == 0
    assert ranked.search(d.where("text = ''"), q).count() == 0


def test_given_table(spark):
    d, q = read(spark, SF001, "documents"), read(spark, SF001, "benchmark")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in q.collect()])
    assert rows(ranked.search(d, q)) == want
