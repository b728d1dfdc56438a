"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion with the ``noop`` sink (every row is
computed, nothing is collected); the figure is the median of warm runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelbench.plans import registry  # noqa: E402
from labelbench.session import get_session  # noqa: E402

HEADLINE = [
    "entry_flagship",
    "X6_shrink_text",
    "W2_stratified_split",
    "W5_three_way_split",
    "J3_split_overlap",
    "A5_describe_tokens_by_class",
    "A20_confusion_counts",
    "A22_precision_recall_f1",
    "A16_wilcoxon_signed_rank",
    "A15_pruned_table",
    "V10_max_pool_layers_max_pool_tokens",
    "V7_max_pool_layers_w_sum_tokens",
    "X11_encode_fixed_length",
]


def run_once(fn, spark, sf) -> float:
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", int(cpus) * 2)))
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs]
    if len(sys.argv) > 1:
        names = [n for n in names if any(p in n for p in sys.argv[1:])]
    out = {}
    for n in names:
        run_once(qs[n], spark, sf_dir)  # warm-up: JIT, file listing, Python workers
        out[n] = round(statistics.median(run_once(qs[n], spark, sf_dir) for _ in range(reps)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
