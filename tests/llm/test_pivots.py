"""Links, components and recall against brute force."""
import numpy as np
import pytest

from labelbench.llm import pivots
from labelbench.llm.tables import read

from conftest import SF01
from test_simhash import brute_components


def brute(rows):
    """{vec_id: number of links}, {vec_id: component}, {(a, b)}"""
    good = {}
    for i, v, l in rows:
        if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (l, np.array(v, float))
    ids = sorted(good)
    links = set()
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.add((a, b))
    n = {i: sum(i in e for e in links) for i, *_ in rows}
    return n, brute_components([i for i, *_ in rows if i is not None], links), links


def _run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    return pivots.near_duplicates(df, **more).collect()


@pytest.mark.parametrize("cell", [1024, 8])
def test_against_brute_force(spark, cell):
    r = np.random.default_rng(cell)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(25):
            x = r.normal(size=16)
            for _ in range(r.integers(1, 6)):
                y = x + r.normal(size=16) * 0.03 * np.abs(x).mean()
                rows.append((i, [float(np.float32(v)) for v in y], label))
                i += 1
    hot = r.normal(size=16)
    for _ in range(60):  # many copies and near copies of one vector
        rows.append((i, [float(np.float32(v)) for v in hot + r.normal(size=16) * (i % 2) * 0.02], 1))
        i += 1
    rows += [(i, rows[0][1], 1), (i + 1, None, 0), (i + 2, [], 0), (i + 3, [0.0] * 16, 0), (i + 4, [float("nan")] * 16, 0),
             (i + 5, [float("inf")] + [1.0] * 15, 0), (i + 6, rows[0][1], None), (i + 7, rows[0][1][:8], 0), (i + 8, rows[0][1][:8], 0),
             (i + 9, [None] + rows[0][1][1:], 0), (i + 10, [2 * v for v in rows[0][1]], 0), rows[3], (i + 11, [1e30] + [0.0] * 15, 0)]
    n, comp, links = brute(rows)
    out = _run(spark, rows, cell=cell)
    assert len(out) == len(rows)
    for x in out:
        assert (x.n_links, x.component_id, x.kept) == (n[x.vec_id], comp[x.vec_id], x.vec_id == comp[x.vec_id])


def test_null_ids_and_versions(spark):
    out = _run(spark, [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)])
    assert sorted((x.vec_id or -1, x.n_links, x.component_id or -1, x.kept) for x in out)[0] == (-1, 0, -1, True)
    assert sorted(x.n_links for x in out if x.vec_id == 1) == [0, 1, 1]
    # every version keeps its links, and no link leads from one version to another
    out = _run(spark, [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.05, 0.0], 1), (3, [0.0, 1.0, 0.05], 1), (5, [0.0, 0.0, 1.0], 1),
                       (4, [0.0, 0.0, 1.0], 1), (5, [0.0, 0.0, 1.0], 2), (4, [0.0, 0.05, 1.0], 1), (4, [0.0, 0.0, 1.0], 1)])
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in out)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (4, 2, 4, True),
                   (5, 0, 5, True), (5, 2, 4, False)]
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_on_the_given_table(spark):
    df = read(spark, SF01, "embeddings")
    rows = [(x.vec_id, list(x.embedding) if x.embedding is not None else None, x.label) for x in df.collect()]
    n, comp, links = brute(rows)
    out = pivots.near_duplicates(df).collect()
    assert sum(x.n_links for x in out) >= 0.97 * 2 * len(links)
    assert all(x.n_links <= n[x.vec_id] for x in out)


def test_recall_close_to_the_threshold():
    """Pairs with cosines from 0.93 to 0.96, in the index's own terms."""
    r = np.random.default_rng(5)
    x = pivots._unit(r.normal(size=(4000, 64)))
    away = r.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    cos = r.uniform(0.93, 0.96, (len(x), 1))
    y = cos * x + np.sqrt(1 - cos * cos) * pivots._unit(away)
    p = pivots.farthest_first(x[:2048], pivots.PIVOTS)
    both = pivots.masks(x, p) & pivots.masks(y, p)
    assert (np.bitwise_count(both) >= pivots.SHARED).mean() >= 0.9


def test_recall_on_planted_links_with_a_common_direction(spark, shared_cos=0.7):
    """Unrelated vectors have a cosine of 0.7, planted links one from 0.93 to 0.96."""
    r = np.random.default_rng(7)
    mean = np.eye(64)[0]
    x = pivots._unit(np.sqrt(shared_cos) * mean + np.sqrt(1 - shared_cos) * pivots._unit(r.normal(size=(1000, 64))))
    away = r.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    cos = r.uniform(0.93, 0.96, (len(x), 1))
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * pivots._unit(away)])
    linked = np.triu(both @ both.T >= 0.93, 1)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    out = pivots.near_duplicates(df).collect()
    assert linked.sum() >= 1000
    assert 0.9 * 2 * linked.sum() <= sum(x.n_links for x in out) <= 2 * linked.sum()
