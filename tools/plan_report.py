"""Write PLANS.md: physical-plan shape of the headline queries at a given sf.

usage: python tools/plan_report.py [sf_dir]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from labelbench.plans import registry  # noqa: E402
from labelbench.session import get_session  # noqa: E402


def shape(plan: str) -> dict:
    # an executed adaptive plan prints the final plan, then the initial one
    plan = plan.split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    ex = [ln for ln in lines if "Exchange" in ln and "BroadcastExchange" not in ln and "ReusedExchange" not in ln]
    return {
        "shuffles": len(ex),
        "reused": sum("ReusedExchange" in ln for ln in lines),
        "broadcasts": sum("BroadcastExchange" in ln for ln in lines),
        "smj": sum("SortMergeJoin" in ln for ln in lines),
        "bhj": sum("BroadcastHashJoin" in ln for ln in lines),
        "windows": sum(bool(re.search(r"\bWindow \[", ln)) for ln in lines),
        "group_limits": sum("WindowGroupLimit" in ln for ln in lines),
        "python": sum(("ArrowEvalPython" in ln) or ("MapInPandas" in ln) or ("BatchEvalPython" in ln) for ln in lines),
        "single_partition": sum("SinglePartition" in ln for ln in lines),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 16)
    qs = registry.queries()
    rows = []
    for n in HEADLINE:
        df = qs[n](spark, sf)
        df.collect()  # run it, so the adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((n, shape(plan)))
    keys = list(rows[0][1])
    out = ["# PLANS", "",
           f"Final (adaptive) physical plans of the headline queries at `{sf}` on local[8], counted by operator.",
           "`shuffles` = exchanges that move rows (hash / range / round-robin / single partition);",
           "`single_partition` = exchanges into one task (only ever on class-, split- or cell-size tables);",
           "`python` = Arrow-batched Python stages.  Generated by `tools/plan_report.py`.", "",
           "| query | " + " | ".join(keys) + " |", "|---|" + "---|" * len(keys)]
    for n, s in rows:
        out.append(f"| {n} | " + " | ".join(str(s[k]) for k in keys) + " |")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
