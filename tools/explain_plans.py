"""Write PLANS.md: the executed (AQE-final) physical plans of the headline
queries at a given scale, trimmed to the operators that matter for scale
(scans with pushed filters and read schema, exchanges, joins, aggregates,
window limits)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit", "Window ",
        "Expand", "FileScan", "BroadcastExchange", "TakeOrdered", "InMemoryTableScan", "ArrowEvalPython",
        "FlatMapGroupsInPandas", "Generate", "AQEShuffleRead")


def main(sf_dir: str, out: str) -> None:
    from tabscope.plans.fixtures import register_views
    from tabscope.plans.profile import TableProfile
    from tabscope.plans import spine
    from tabscope.plans.registry import QUERIES
    from tabscope.session import local_session

    spark = local_session(8, shuffle_partitions=16, app="tabscope-plans")
    register_views(spark, sf_dir)
    p = TableProfile(spark.table("li_nulls"))
    frames = {
        "F: frequency scan (values, null patterns)": spine.frequencies(p.base, p.specs),
        "per-column aggregate over F": spine.column_stats(p.freq, p.specs, p.n_rows),
    }
    for name in ["sql_filter_project", "sql_join_inner", "sql_group_agg", "histogram", "asof_join",
                 "duplicate_row_list", "check_foreign_key_lineitem", "dynamics_median",
                 "interval_join_hot_key", "running_totals_hot_key"]:
        frames[name] = QUERIES[name](spark, sf_dir)
    lines = [f"# Executed plans ({os.path.basename(sf_dir.rstrip('/'))}, local[8], 16 shuffle partitions)", "",
             "Generated by `python tools/explain_plans.py`. Each block is the AQE-final physical plan",
             "after the query ran, keeping scans, exchanges, joins, aggregates and window limits.", ""]
    for title, df in frames.items():
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Adaptive plans print the final plan, then the initial one: keep the final.
        plan = plan.split("== Initial Plan ==")[0]
        kept = [ln.rstrip()[:220] for ln in plan.splitlines() if any(k in ln for k in KEEP)]
        lines += [f"## {title}", "", "```", *kept, "```", ""]
    with open(out, "w") as fh:
        fh.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main(os.environ.get("PLANS_SF_DIR", "/root/testdata/sf0.1"), os.path.join(os.path.dirname(__file__), "..", "PLANS.md"))
