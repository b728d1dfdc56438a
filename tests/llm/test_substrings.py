"""Removed windows against brute force; the automaton against plain search."""
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import substrings
from labelbench.llm.tables import read

from conftest import SF001


def brute(rows, size):
    """[(n_words, n_removed, sha)] for rows of (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = -(1 << 63)
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - size + 1):
            key, place = tuple(w[s:s + size]), (low if i is None else i, s)
            first[key] = min(first.get(key, place), place)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < (low if i is None else i, s):
                gone.update(range(s, s + size))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=5), st.text("abc", max_size=15))
def test_automaton(known, text):
    a = substrings.Automaton()
    for k in known:
        a.add(list(k))
    want = [max(n for n in range(e + 2) if n == 0 or any(text[e + 1 - n:e + 1] in k for k in known)) for e in range(len(text))]
    assert list(a.matches(list(text))) == want


def _corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["w%d" % i for i in range(400)] + ["é", "W1"])
    prose = lambda n: [word() for _ in range(n)]
    passage, short, base = prose(60), prose(9), [prose(r.randint(5, 120)) for _ in range(12)]
    texts = [" ".join(b) for b in base] + [None, "", " \n"]
    for _ in range(12):  # one passage, or a part of it, in the middle of other words
        a, b = sorted(r.sample(range(61), 2))
        texts.append(" ".join(prose(r.randint(0, 30)) + passage[a:b] + short + prose(r.randint(0, 30))))
    for b in base:  # copies, edited ones and one inside another document
        texts.append("\n".join(b))
        c = list(b)
        c[r.randrange(len(c))] = "edited"
        texts.append(" ".join(c))
    texts += [" ".join(base[0] * 3), "again " * 70, "x y " * 40, " ".join(passage) + " tail", " ".join(base[1] + base[2] + base[1])]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[0], (rows[1][0], " ".join(passage)), (None, " ".join(passage)), (None, " ".join(base[3]))]


@pytest.mark.parametrize("seed,size,gram,most", [(1, 20, 8, 2048), (2, 20, 8, 1), (3, 7, 3, 2), (4, 20, 8, 3)])
def test_report(spark, seed, size, gram, most):
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.report(docs, size, gram, most).collect())
    want = sorted((i is not None, i or 0, *b) for (i, _), b in zip(rows, brute(rows, size)))
    assert got == want


@pytest.mark.parametrize("most", [2048, 1])
@pytest.mark.parametrize("shared", [None, 7])
def test_rows_that_share_an_id(spark, shared, most):
    """Windows of rows with one doc_id, or none, go where the same words start earlier in any of them."""
    run = [f"w{i}" for i in range(30)]
    rows = [(shared, " ".join(["z"] + run)), (shared, " ".join(run)), (shared, " ".join(["a", "b"] + run + ["c"])), (shared, " ".join(run[3:] + ["t"])), (9, " ".join(run))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id or 0, x.n_words, x.n_removed) for x in substrings.report(docs, most=most).collect())
    assert got == sorted((i or 0, n, gone) for (i, _), (n, gone, _) in zip(rows, brute(rows, 20)))
    assert (shared or 0, 31, 30) in got and (shared or 0, 33, 30) in got


def test_contexts_share_out_the_windows():
    rows = _corpus(5)
    got = [substrings.contexts(substrings.words_of(t)) for _, t in rows]
    assert any(g is not None for g in got)
    for g, (_, t) in zip(got, rows):
        n = len(substrings.words_of(t))
        if n >= 20:
            assert [s for a, b in zip(g[3], g[4]) for s in range(a, b + 1)] == list(range(n - 19))


def test_remove(spark):
    rows = [(i, t, "s", len(t or ""), "x") for i, t in _corpus(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int, d string")
    out = substrings.remove(docs)
    assert out.schema == docs.schema
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.text or "") for x in out.collect())
    want = []
    for (i, t, *_), (n, gone, sha) in zip(rows, brute([r[:2] for r in rows], 20)):
        if not gone:
            want.append((i is not None, i or 0, t or ""))
        elif gone < n:
            want.append((i is not None, i or 0, sha))
    assert len(got) == len(want)
    plain = {w[2] for w in want}
    assert all(t in plain or hashlib.sha256(t.encode()).hexdigest() in plain for _, _, t in got)
    assert all(x.n_chars == len(x.text or "") and x.d == "x" for x in out.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.report(docs).count() == 0 and substrings.remove(docs).count() == 0


def test_given_table(spark):
    docs = read(spark, SF001, "documents")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.report(docs).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(rows, brute(rows, 20)))
