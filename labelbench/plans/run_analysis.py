"""Run-analysis job: run table -> every result table of the analysis.

The cleaned run table (P6 + W1) is written once as parquet in the shared
checkpoint folder (or ``out_dir``); every table below reads that written copy,
so the raw runs are scanned and de-duplicated once, and a lost executor
recomputes from the written table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..operators import runs as R
from ..session import cut_lineage

SERIES_METRIC = "acc_test"


def analyse(runs: DataFrame, metric: str = "acc_test", out_dir: str | None = None) -> dict:
    clean = R.clean_runs(runs, "acc_test")
    if out_dir:
        clean.write.mode("overwrite").parquet(os.path.join(out_dir, "clean_runs"))
        clean = runs.sparkSession.read.parquet(os.path.join(out_dir, "clean_runs"))
    else:
        clean = cut_lineage(clean)
    delta_long = R.delta_matrix(clean, metric, long=True)
    series = R.series_means(clean, SERIES_METRIC)
    return {
        "clean": clean,
        "missing_runs": R.missing_runs(runs),
        "seed_coverage": R.seed_coverage(clean),
        "cell_stats": R.cell_stats(clean, metric),
        "tests": R.cell_tests(clean, metric),
        "effects": R.cell_effects(clean, metric),
        "all_cells": R.all_cells_with_p(clean, metric),
        "delta_matrix": R.delta_matrix(clean, metric),
        "best_cell": R.best_cell(delta_long),
        "pruned_table": R.pruned_table(clean),
        "param_overhead": R.param_overhead(clean),
        "series": series,
        "global_range": R.global_range(delta_long, series),
    }
