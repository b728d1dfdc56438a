"""Spark query vs its SQL twin on sf0.001 for a representative set of operators."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from labelbench.session import TABLES

from conftest import SF001

NAMES = ["entry_flagship", "X6_shrink_text", "W2_stratified_split", "W5_three_way_split", "J3_split_overlap",
         "A5_describe_tokens_by_class_wide", "A16_wilcoxon_signed_rank", "A15_pruned_table",
         "V7_max_pool_layers_w_sum_tokens", "X11_encode_fixed_length", "X8_layout_tokens", "S9_read_runs_csv"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf.astype(object).where(pdf.notna(), None)

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "tolist"):
            return tuple(v.tolist())
        return v
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = _rows(E.queries()[name](spark, SF001).toPandas())
    want = _rows(con.execute(E.oracle_sql()[name]).df())
    assert got == want
