"""Fingerprints, links and components against brute force."""
import random
import re

import pytest
import xxhash

from labelbench.llm import simhash
from labelbench.llm.components import components


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            for n in (a, b):
                if comp[n] != low:
                    comp[n], changed = low, True
    return comp


TEXTS = [None, "", " \n\t", "One", "one", "ONE two", "a b c d", "A B c D", "É é É é", "x\x1cy z\x85w v", "word " * 500, "the same text here", "The Same text here"]


def test_fingerprints():
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (2, 3, 4, 50, 333)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_budgets():
    assert simhash.budgets(3) == [0, 0, 1, 1, 1, 2, 2, 3]


def _near(r, fp, k):
    for bit in r.sample(range(64), k):
        fp ^= 1 << bit
    return fp - (1 << 64) if fp >> 63 else fp


@pytest.mark.parametrize("block", [1 << 14, 4])
def test_links_give_the_brute_force_components(spark, block):
    r = random.Random(block)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = {_near(r, s, r.randint(0, 7)) for s in seeds for _ in range(12)}
    fps |= {_near(r, seeds[0], r.randint(1, 2)) for _ in range(150)} | {0, -1, 7, 15}
    fps = sorted(fps)
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect()}
    mask = (1 << 64) - 1
    brute = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & mask).bit_count() <= 3]
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in got)
    assert brute_components(fps, got) == brute_components(fps, brute)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 900 + i) for i in range(50)] + [(3, 3)]
    edges += [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(70)]
    nodes = {n for e in edges for n in e}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(nodes, edges)
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(2)
    vocab = ["w%d" % i for i in range(60)]
    base = [" ".join(r.choice(vocab) for _ in range(300)) for _ in range(6)]
    texts = TEXTS + base + [b.replace(" w1 ", " W1 ") for b in base] + [b + " tail" for b in base] + base[:2]
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (4, "something else entirely", "c"), (None, "one", "c")], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows) + 3
    pairs = [(x.doc_id, x.fingerprint, x.component_id) for x in out if x.doc_id is not None]
    assert {(i, f"{brute_fingerprint(t):016x}") for i, t, _ in rows} <= {(i, f) for i, f, _ in pairs}
    linked = [(a, b) for a, f, _ in pairs for b, g, _ in pairs if (int(f, 16) ^ int(g, 16)).bit_count() <= 3]
    want = brute_components({p[0] for p in pairs}, linked)
    assert all(want[i] == c for i, _, c in pairs)
    assert [x.component_id for x in out if x.doc_id is None] == [None]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({c for _, _, c in pairs})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_with_columns_that_have_no_order(spark):
    rows = [(1, "a b c d", {"k": 1}), (1, "a b c d", {"k": 1}), (1, "a b c c", {"k": 0}), (2, "a b c d", {"k": 2}), (3, "quite other words here", {}), (None, "a b c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted((x.doc_id or 0, x.text) for x in out.collect())
    assert got == [(0, "a b c d"), (1, "a b c c"), (3, "quite other words here")]
