"""The schedule against plain earliest-deadline-first, its deviation, and whole tables."""
import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelbench.llm import mixing


def brute(weights, horizon):
    """source and block of every slot, by earliest deadline first over all blocks (ties: by name)."""
    names = sorted(weights, key=str)
    share = [Fraction(s, mixing.UNIT) for s in mixing.shares({s: weights[s] for s in names})]
    done, out = [0] * len(names), []
    for t in range(horizon):
        _, i = min((ceil((j + 1) / w), i) for i, (w, j) in enumerate(zip(share, done)) if floor(j / w) <= t)
        out.append((names[i], done[i]))
        done[i] += 1
    return out


def worst(weights, slots):
    """The largest deviation from the exact weights at any slot, in blocks."""
    total, got, most = sum(map(Fraction, weights)), [0] * len(weights), 0
    share = [Fraction(w) / total for w in weights]
    for t, i in enumerate(slots):
        got[i] += 1
        most = max(most, max(abs(n - w * (t + 1)) for n, w in zip(got, share)))
    return most


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(1, 30))
def test_schedule(weights, n):
    share = mixing.shares(dict(enumerate(weights)))
    slots = mixing.schedule(share, [n] * len(weights))
    assert [s for s, _ in brute(dict(enumerate(weights)), len(slots))] == slots
    assert min(Counter(slots).values()) == n and Counter(slots[:-1])[slots[-1]] == n - 1
    seen = Counter()
    for t, i in enumerate(slots):
        release, deadline = mixing.window(share[i], seen[i])
        assert release <= t < deadline
        seen[i] += 1
    assert worst(weights, slots) < 1


@given(st.dictionaries(st.text(max_size=3), st.floats(1e-6, 1e6), min_size=1, max_size=30))
def test_shares(weights):
    out = mixing.shares(weights)
    assert sum(out) == mixing.UNIT and min(out) >= 1
    assert all(abs(s / mixing.UNIT - w / sum(weights.values())) < 1e-9 for s, w in zip(out, weights.values()))


def test_blocks_grow_where_the_mix_would_be_long():
    share = mixing.shares({"a": 1, "b": 1})
    assert mixing.block_size([1000, 10], share, 64, 1 << 20) == 64
    block = mixing.block_size([10**12, 10], share, 64, 1 << 20)
    assert len(mixing.schedule(share, [-(-10**12 // block), 1])) <= (1 << 20) + 2


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 1, None: 2, "c": 4}])
def test_place(spark, weights):
    r = random.Random(1)
    rows = [(i, r.choice("aaaaaaaabbc") if i % 17 else None, "t%d" % (i % 5), i) for i in range(400)] + [(7, "a", None, 7)] * 2 + [(None, "b", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int").repartition(4).cache()
    out = mixing.place(docs, weights, block=8).collect()  # the input's own column slot is replaced
    sizes = Counter(s for _, s, *_ in rows)
    end = max(x.slot for x in out)
    order = brute(weights or {s: n ** mixing.TEMPERATURE for s, n in sizes.items()}, end + 1)
    blocks = defaultdict(list)
    for x in out:
        assert order[x.slot] == (x.source, x.block)
        assert x.release <= x.slot < x.deadline
        blocks[x.source, x.block].append(x)
    assert set(order) == set(blocks)
    for (s, b), xs in blocks.items():
        per = -(-sizes[s] // 8)
        size = 8 if b % per < per - 1 else sizes[s] - 8 * (per - 1)
        assert sorted(x.position for x in xs) == list(range(size)) and {x.epoch for x in xs} == {b // per}
    # every row is read once an epoch, and once at least
    first = Counter((x.doc_id, x.source, x.text) for x in out if x.epoch == 0)
    assert first == Counter(r[:3] for r in rows)
    again = Counter((x.doc_id, x.source, x.text, x.epoch) for x in out)
    assert all(n <= first[k[:3]] for k, n in again.items())
    # it ends with the slot in which the last source has been read once
    assert any(x.epoch == 0 and x.slot == end for x in out)


def test_mix(spark):
    rows = [(i, "ab"[i % 3 == 0], "t", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "position long, source string, text string, epoch string").repartition(3).cache()
    out = mixing.mix(docs, {"a": 3, "b": 1}, block=4)
    assert out.columns == docs.columns
    got = out.collect()
    assert {x.position for x in got} == set(range(300))
    head = Counter(x.source for x in got[:64])
    assert abs(head["a"] - 48) <= 4
    with pytest.raises(ValueError):
        mixing.place(docs.select("source"), {"a": 1}).collect()
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [
    {"a": 0.999, "b": 0.001}, {"hot": 0.9} | {f"s{i}": 0.005 for i in range(20)}, {"hot": 1 / 3} | {f"s{i}": 1 / 30 for i in range(20)},
    {"a": 1.0, "b": 1e-5, "c": 1e-5, "d": 0.3}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{n}": n ** 0.7 for n in (5, 17, 90, 400, 1100, 7000, 31000, 120000)}])
def test_deviation_from_the_target_weights(weights):
    """Less than one block at every slot, however long the mix lasts."""
    share = mixing.shares(weights)
    slots = mixing.schedule(share, [max(1, 20_000 * s // mixing.UNIT) for s in share])
    assert len(slots) >= 19_000 and worst(list(weights.values()), slots[:40_000]) < 1


def test_shares_of_a_long_mix(spark):
    docs = spark.range(4010).selectExpr("id doc_id", "if(id < 4000, 'a', 'b') source").repartition(3).cache()
    out = mixing.place(docs, {"a": 0.999, "b": 0.001}, block=1).collect()
    n, slots = Counter(x.source for x in out), max(x.slot for x in out) + 1
    assert len(out) == slots and abs(n["b"] - slots * 0.001) < 1
    assert len({x.doc_id for x in out if x.epoch == 0}) == 4010


def test_input_read_again_in_other_tasks(spark, tmp_dir):
    """The partitions of the input's scan change between the call and the action, as when executors are lost."""
    spark.range(4000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source").repartition(8).write.parquet(f"{tmp_dir}/documents")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2k")
        out = mixing.place(spark.read.parquet(f"{tmp_dir}/documents"), {"a": 1, "b": 2}, block=8)
        spark.conf.set(key, "128m")
        got = out.collect()
    finally:
        spark.conf.set(key, before)
    assert {x.doc_id for x in got if x.epoch == 0} == set(range(4000))
    assert len({(x.slot, x.position) for x in got}) == len(got)


def test_texts_are_numbered_without_python(spark):
    """Only the sources go to the Python workers, and every source is counted over all batches of a task."""
    docs = spark.range(5000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', null) source", "repeat('x', 50) text").repartition(2)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "300")
        out = mixing._numbered(docs)
        rows = out.collect()
    finally:
        spark.conf.set(size, before)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython [at(source" in plan
    places = defaultdict(list)
    for x in rows:
        places[x["__task"], x.source].append(x["__row"])
    assert len(rows) == 5000 and all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("weights", [[1, 1, 4], [1, 2, 3], [3, 3, 1], [5, 7, 9, 21]])
def test_weights_that_are_no_binary_fractions(weights):
    """A rounded weight would let a block start a slot too early, a whole block ahead of the exact weight."""
    share = mixing.shares(dict(enumerate(weights)))
    assert [s / mixing.UNIT for s in share] == [Fraction(w, sum(weights)) for w in weights]
    assert worst(weights, mixing.schedule(share, [50] * len(weights))) < 1


def test_sources_need_no_workers_of_their_own(spark, tmp_dir):
    """A table made of a Python list would be read by a second pool of Python workers, which stay beside the first."""
    docs = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None) for i in range(600)], "doc_id long, source string")
    docs.write.parquet(f"{tmp_dir}/documents")
    out = mixing.place(spark.read.parquet(f"{tmp_dir}/documents"), {"a": 1, "b": 2, None: 3}, block=8)
    assert len({x.doc_id for x in out.collect() if x.epoch == 0}) == 600
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "binary"])
def test_sources_of_other_types(spark, kind):
    value = {"int": "id % 3", "date": "date_add(date'2020-01-01', int(id % 3))", "timestamp": "timestamp_seconds(id % 3)", "binary": "cast(string(id % 3) as binary)"}[kind]
    docs = spark.range(600).selectExpr("id doc_id", f"if(id % 7 = 0, null, {value}) source").repartition(2).cache()
    out = mixing.place(docs, block=8)
    first = Counter((x.doc_id, x.source) for x in out.where("epoch = 0").collect())
    assert first == Counter((x.doc_id, x.source) for x in docs.collect()) and len(first) == 600
