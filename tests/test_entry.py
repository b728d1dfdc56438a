"""Driver contract."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["label", "train", "valid", "test"]
    assert rows[-1].label == "Total" and rows[-1].train > 0


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_bench_headline_queries_are_registered():
    from bench import HEADLINE
    assert set(HEADLINE) <= set(E.queries())
