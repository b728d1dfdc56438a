"""Codes against comparing every part with every entry in plain Python; the tree against a full scan."""
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import gnat
from labelbench.llm.tables import read

from conftest import SF001


def brute(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, code, error, label_error, digest)] of (vec_id, label, vector) rows of one length."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    length, cuts = len(kept[0][2]), gnat.bounds(len(kept[0][2]), parts)
    assert all(len(v) == length for _, _, v in kept)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[a:b] for _, _, v in first] for a, b in cuts]

    def nearest(part, p):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = defaultdict(list)
        for _, _, v in kept:
            for p, (a, b) in enumerate(cuts):
                got[p, nearest(v[a:b], p)[1]].append(v[a:b])
        for (p, e), own in got.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, by_label = [], defaultdict(int)
    for i, lab, v in kept:
        near = [nearest(v[a:b], p) for p, (a, b) in enumerate(cuts)]
        error = sum(d for d, _ in near)
        by_label[lab] += error
        found.append((i, "".join(f"{k:02x}" for _, k in near), error, lab))
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in found), key=repr)


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<float>, code string")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]  # as floats of 32 bits
    assert sorted(map(tuple, gnat.compress(df.repartition(3), **more).collect()), key=repr) == brute(rows, **more)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(0, 6), st.sampled_from([1, 3, 50, 10**6, 10**8]), st.integers(1, 6))
def test_tree_against_a_scan(seed, k, d, size, degree):
    r = np.random.default_rng(seed)
    entries, x = r.integers(-size, size + 1, (k, d)), r.integers(-size, size + 1, (200, d))
    if seed % 2:
        entries[r.integers(0, k, k // 2)] = entries[0]  # equal entries
    index, best = gnat.Gnat(entries, degree).nearest(x)
    all_d = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (index == all_d.argmin(axis=1)).all() and (best == all_d.min(axis=1)).all()


def test_tree_rules_out_children():
    """Queries near an entry meet few of the others."""
    r = np.random.default_rng(1)
    tree = gnat.Gnat(r.integers(-10**6, 10**6, (256, 2)))
    seen, plain = [], gnat.squared
    try:
        gnat.squared = lambda x, p: seen.append(len(x)) or plain(x, p)
        tree.nearest(r.integers(-10**6, 10**6, (1000, 2)))
    finally:
        gnat.squared = plain
    assert sum(seen) < 0.3 * 256 * 1000


def test_rows(spark):
    r = random.Random(2)
    vector = lambda: [r.gauss(0, 1) for _ in range(16)]
    rows = [(i, r.choice([1, 2, None]), vector()) for i in range(150)]
    rows += [(200 + i, 3, rows[5][2]) for i in range(20)]  # copies
    rows += [(5, 1, vector()), (5, 2, vector()), (None, 1, vector()), (300, 1, None), (301, 2, [math.nan] + [0.0] * 15), (-7, 2, [1.0] * 15 + [math.inf]),
             (-8, 1, [1.0] * 15 + [None]), (303, None, [0.0] * 16), (304, None, [-1e-9] * 16), (305, 4, [1000.0] * 16)]
    check(spark, rows)
    check(spark, rows[:7])
    check(spark, rows, parts=5, entries=6, rounds=2)


def test_ties_and_small_integers(spark):
    r = random.Random(3)
    check(spark, [(i, i % 2, [r.randint(-1, 1) / 4096 for _ in range(8)]) for i in range(120)])


def test_other_lengths(spark):
    rows = [(i, 1, [float(i), 1.0] * 4) for i in range(5)]
    df = spark.createDataFrame([*rows, (9, 1, [1.0]), (10, None, [])], "vec_id long, label int, embedding array<double>")
    out = {r.vec_id: r for r in gnat.compress(df).collect()}
    want = {w[0]: w for w in brute(rows)}
    assert {i: tuple(out[i]) for i in want} == want and out[9].code is None and out[9].error is None
    assert out[9].label_error == want[0][3] and out[10].label_error is None


def test_empty_and_null_tables(spark):
    schema = "vec_id long, label string, embedding array<float>"
    assert gnat.compress(spark.createDataFrame([], schema)).count() == 0
    assert gnat.compress(spark.createDataFrame([(1, "a", None)], schema)).count() == 0
    assert gnat.compress(spark.createDataFrame([(1, "a", [])], schema)).first().error == 0


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        gnat.compress(spark.createDataFrame([(1, "a", [1e9] * 8)], "vec_id long, label string, embedding array<double>")).collect()


def test_given_table(spark):
    table = read(spark, SF001, "embeddings")
    want = brute([(r.vec_id, r.label, r.embedding) for r in table.collect()])
    assert sorted(map(tuple, gnat.compress(table).collect()), key=repr) == want
