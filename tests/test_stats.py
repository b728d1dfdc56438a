"""A16 against full enumeration of sign patterns; A17 and J8 against pairs."""
import itertools
import math

import pytest

from labelbench.operators import stats as ST


def avg_ranks(xs):
    order = sorted(range(len(xs)), key=lambda i: xs[i])
    r = [0.0] * len(xs)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and xs[order[j + 1]] == xs[order[i]]:
            j += 1
        for k in range(i, j + 1):
            r[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return r


def py_wilcoxon(d):
    nz = [x for x in d if x != 0]
    n = len(nz)
    if n == 0:
        return None
    r = avg_ranks([abs(x) for x in nz])
    wp = sum(ri for ri, x in zip(r, nz) if x > 0)
    wm = sum(ri for ri, x in zip(r, nz) if x < 0)
    t = min(wp, wm)
    ties = len(set(abs(x) for x in nz)) < n
    if n <= 12 and not ties and len(nz) == len(d):
        ranks = list(range(1, n + 1))
        cnt = sum(1 for signs in itertools.product([0, 1], repeat=n)
                  if sum(rk for rk, s in zip(ranks, signs) if s) <= t)
        return min(1.0, 2 * cnt / 2 ** n)
    from collections import Counter
    tie_term = sum(c * (c * c - 1) for c in Counter(abs(x) for x in nz).values())
    se = math.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * tie_term) / 24)
    z = (t - n * (n + 1) / 4) / se
    return math.erfc(abs(z) / math.sqrt(2))


GROUPS = {
    "n10_exact": [0.3, -0.1, 0.25, 0.7, -0.05, 0.9, 0.45, -0.6, 0.15, 0.8],
    "n10_all_pos": [0.1 * i for i in range(1, 11)],
    "ties": [0.1, 0.1, -0.1, 0.2, 0.3, -0.3],
    "one_zero": [0.0, 0.2, -0.5, 0.9, 0.4],
    "all_zero": [0.0, 0.0, 0.0],
    "n1": [0.4],
    "n12": [((-1) ** i) * (i + 1) / 7 for i in range(12)],
    "n51_normal": [((-1) ** (i % 3)) * (i + 1) / 10 for i in range(51)],  # past the exact limit
}


def test_wilcoxon_against_enumeration(spark):
    rows = [(g, float(x)) for g, ds in GROUPS.items() for x in ds]
    df = spark.createDataFrame(rows, "g string, d double")
    got = {r.g: r for r in ST.wilcoxon_signed_rank(df, ["g"], "d").collect()}
    for g, ds in GROUPS.items():
        want = py_wilcoxon(ds)
        if want is None:
            assert got[g].p_value is None
        elif g == "n51_normal":
            assert got[g].method == "approx" and got[g].p_value == pytest.approx(want, rel=1e-11)
        elif got[g].method == "exact":
            assert got[g].p_value == pytest.approx(want, abs=1e-12), g
        else:  # normal tail: erfc by series / continued fraction, within 1e-11 of math.erfc
            assert got[g].p_value == pytest.approx(want, rel=1e-11), g


def test_exact_with_ties_and_zeros_against_enumeration(spark):
    """All sign patterns of the groups' own mid-ranks."""
    import random
    r = random.Random(11)
    groups = {f"r{k}": [r.choice([-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4]) for _ in range(r.randint(1, 12))] for k in range(25)}
    groups |= {g: ds for g, ds in GROUPS.items() if len(ds) <= 12} | {"same": [0.5] * 12, "long": [0.1 * (i // 3 + 1) * (-1) ** (i % 4 == 0) for i in range(50)]}
    rows = [(g, float(x)) for g, ds in groups.items() for x in ds]
    got = {x.g: x for x in ST.wilcoxon_signed_rank(spark.createDataFrame(rows, "g string, d double"), ["g"], "d", method="exact").collect()}
    assert set(got) == set(groups)
    for g, ds in groups.items():
        nz = [x for x in ds if x]
        if not nz:
            assert got[g].p_value is None and got[g].method is None
            continue
        a = sorted(map(abs, nz))
        rank = [a.index(abs(x)) + a.count(abs(x)) / 2 + 0.5 for x in nz]
        t = min(sum(k for k, x in zip(rank, nz) if x > 0), sum(k for k, x in zip(rank, nz) if x < 0))
        sums = {0.0: 1}  # subsets of the ranks by their sum; for short groups this is the enumeration of all signs
        for k in rank:
            sums = {w: sums.get(w, 0) + sums.get(w - k, 0) for w in {*sums, *(w + k for w in sums)}}
        if len(nz) <= 10:
            assert sum(sums.values()) == sum(1 for _ in itertools.product([0, 1], repeat=len(nz)))
            assert sum(c for w, c in sums.items() if w <= t) == sum(sum(k for k, s in zip(rank, signs) if s) <= t for signs in itertools.product([0, 1], repeat=len(nz)))
        want = min(1.0, 2 * sum(c for w, c in sums.items() if w <= t) / 2 ** len(nz))
        assert got[g].method == "exact" and got[g].p_value == pytest.approx(want, rel=1e-12), g
    too_many = spark.createDataFrame([("g", float(i + 1)) for i in range(51)], "g string, d double")
    with pytest.raises(Exception, match="too many pairs"):
        ST.wilcoxon_signed_rank(too_many, ["g"], "d", method="exact").collect()


def _py_table(max_n):
    rows, counts = {}, [1]
    for n in range(1, max_n + 1):
        new = [0] * (len(counts) + n)
        for w, c in enumerate(counts):
            new[w] += c
            new[w + n] += c
        counts = new
        run = 0
        for w, c in enumerate(counts):
            run += c
            rows[(n, w)] = run / 2 ** n
    return rows


def test_exact_table(spark):
    got = {(r.n, r.w): r.cdf for r in ST.signed_rank_table(spark, 20).collect()}
    assert got == _py_table(20)
    assert ST.signed_rank_table(spark).count() == 22150
    assert 2 * got[(10, 8)] == pytest.approx(0.048828125)
    assert 2 * got[(10, 9)] == pytest.approx(0.064453125)
    assert 2 * got[(10, 0)] == pytest.approx(0.001953125)


def py_a12(a, b):
    more = sum(1 for x in a for y in b if x > y)
    same = sum(1 for x in a for y in b if x == y)
    s = (more + 0.5 * same) / (len(a) * len(b))
    return max(s, 1 - s), more, same


def test_a12_and_pairs(spark):
    samples = {"g1": ([1, 2, 3, 3, 5], [2, 3, 4]), "g2": ([0.5] * 4, [0.5, 0.7]), "g3": ([9, 8, 7], [1, 2])}
    rows = [(g, side, float(v)) for g, (a, b) in samples.items() for side, vs in ((1, a), (2, b)) for v in vs]
    df = spark.createDataFrame(rows, "g string, side int, value double")
    eff = {r.g: r for r in ST.a12_effect_size(df, ["g"]).collect()}
    pairs = {r.g: r for r in ST.pair_counts(df, ["g"]).collect()}
    for g, (a, b) in samples.items():
        want, more, same = py_a12(a, b)
        assert eff[g].a12 == pytest.approx(want)
        assert (pairs[g].more, pairs[g].same, pairs[g].pairs) == (more, same, len(a) * len(b))
    assert eff["g3"].band == "large"



def test_erfc_against_math(spark):
    import math
    xs = [i / 50.0 for i in range(0, 501)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.e for r in df.select(ST.erfc(df.x).alias("e")).collect()]
    for x, e in zip(xs, got):
        assert e == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300)


def test_wilcoxon_random_samples(spark):
    import random
    rng = random.Random(11)
    groups = {}
    for g in range(25):
        n = rng.randint(1, 12)
        if g % 2:  # distinct magnitudes, no zeros: the exact branch
            mags = rng.sample(range(1, 40), n)
            groups[f"g{g}"] = [m / 10 * rng.choice([-1, 1]) for m in mags]
        else:      # small integers: ties and zeros, the normal branch
            groups[f"g{g}"] = [float(rng.randint(-3, 3)) for _ in range(n)]
    rows = [(g, x) for g, ds in groups.items() for x in ds]
    got = {r.g: r.p_value for r in ST.wilcoxon_signed_rank(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    for g, ds in groups.items():
        want = py_wilcoxon(ds)
        if want is None:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(want, rel=1e-11, abs=1e-15), (g, ds)


def test_a12_random_against_pairs(spark):
    import random
    rng = random.Random(13)
    samples = {f"g{i}": ([rng.randint(0, 6) / 2 for _ in range(rng.randint(1, 12))],
                         [rng.randint(0, 6) / 2 for _ in range(rng.randint(1, 12))]) for i in range(20)}
    rows = [(g, side, float(v)) for g, (a, b) in samples.items() for side, vs in ((1, a), (2, b)) for v in vs]
    df = spark.createDataFrame(rows, "g string, side int, value double")
    eff = {r.g: r.a12 for r in ST.a12_effect_size(df, ["g"]).collect()}
    pairs = {r.g: (r.more, r.same) for r in ST.pair_counts(df, ["g"]).collect()}
    for g, (a, b) in samples.items():
        want, more, same = py_a12(a, b)
        assert eff[g] == pytest.approx(want, abs=1e-12)
        assert pairs[g] == (more, same)
