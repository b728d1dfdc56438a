"""Plan shape: the heavy operators keep the properties the design relies on."""
from labelbench.operators import pooling as PO
from labelbench.operators import splits as SP
from labelbench.operators import runs as R
from labelbench.plans.fixtures import hidden_states, labelled_quality, labelled_text, runs
from labelbench.plans.prepare_queries import shrunk_text

from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_functions_stay_in_the_jvm(spark):
    p = _plan(shrunk_text(spark, SF01))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_split_does_not_move_rows(spark):
    """The rows of a split stay where they are: a scan, a broadcast of one row for each class, and a comparison."""
    docs = labelled_text(spark, SF01).drop("split")
    for df in (SP.three_way_split(docs, "label", "ord"), SP.stratified_split(docs, "label", "ord", 0.1)):
        df.collect()
        text = _plan(df)  # the final adaptive plan
        assert "src" in text and "Window" not in text
        assert [x for x in text.splitlines() if "Exchange" in x and "BroadcastExchange" not in x] == []


def test_split_beyond_the_broadcast_bound_ranks_per_bucket(spark):
    df = SP.three_way_split(labelled_quality(spark, SF01), "label", "ord", most_classes=1, ranked_rows=10)
    text = _plan(df)
    # the example-level row_number runs per (label, bucket), never in one global partition
    seen = 0
    for line in text.splitlines():
        if "row_number()" in line and "__rn_local" in line:
            seen += 1
            assert "__kn0" in line and "__kv0" in line and "__bucket" in line
    assert seen >= 1


def test_pooling_uses_partial_aggregation(spark):
    p = _plan(PO.max_pool_layers_max_pool_tokens(hidden_states(spark, SF01)))
    assert p.count("ObjectHashAggregate") + p.count("SortAggregate") >= 2  # partial + final


def test_pushdown_and_pruning(spark):
    df = PO.one_layer_cls(hidden_states(spark, SF01), 7)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "embedding" in text and "label" not in text.split("ReadSchema")[-1].split("\n")[0]


def test_signed_rank_table_is_broadcast(spark):
    p = _plan(R.cell_tests(R.clean_runs(runs(spark, SF01)), "acc_test"))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_labelled_text_scan_reads_only_needed_columns(spark):
    lt = labelled_text(spark, SF01).select("ord", "label")
    p = lt._jdf.queryExecution().executedPlan().toString()
    assert "text" not in p.split("ReadSchema:")[-1].split("]")[0]


def test_no_registered_query_plans_a_cross_join_or_row_udf(spark):
    from labelbench.plans import registry
    from conftest import SF001
    bad = {}
    for name, fn in registry.queries().items():
        plan = _plan(fn(spark, SF001))
        hits = [k for k in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "InPandas",
                            "RoundRobinPartitioning", "wholetext") if k in plan]
        if hits:
            bad[name] = hits
    assert bad == {}
