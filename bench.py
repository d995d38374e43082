"""Benchmark: headline report queries on $BENCH_SF_DIR (default /root/testdata/sf0.1),
local[$BENCH_CPUS]. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Headline set: the full column report, the table-level parts, chart data,
# the guarded SQL surface and the as-of join.
HEADLINE = [
    "report_lineitem_full",
    "profile_columns",
    "profile_columns_orders",
    "top_values",
    "duplicate_rows",
    "duplicate_row_list",
    "missing_correlation",
    "correlation_matrix",
    "histogram",
    "category_frequency",
    "dynamics_sum",
    "dynamics_median",
    "dynamics_text_dates",
    "normality_jb",
    "sql_group_agg",
    "sql_join_inner",
    "sql_window_rank",
    "sql_interval_join",
    "asof_join",
    "check_foreign_key_lineitem",
    "chat_summaries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tabscope.session import local_session
    from tabscope.plans.registry import QUERIES

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="tabscope-bench")
    # Warm the JVM and the Python workers once (class loading, code generation,
    # worker start) on 1,000 generated rows, outside the timings: the numbers
    # below are warm-service latencies.
    from tabscope.plans.profile import TableProfile

    warm = spark.range(1000).selectExpr("id", "id % 7 AS k", "CAST(id AS STRING) AS s", "id * 0.5 AS x")
    with TableProfile(warm) as p:
        p.columns.collect()
        p.correlation_matrix().collect()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    # Catalog load (Parquet footers of every table) is timed on its own.
    from tabscope.plans.fixtures import register_views

    t0 = time.perf_counter()
    register_views(spark, sf_dir)
    times["catalog_load"] = round(time.perf_counter() - t0, 3)
    def full_report(spark, sf_dir):
        """Every report part of one table from one TableProfile (shared scans)."""
        from tabscope.plans.fixtures import table

        with TableProfile(table(spark, sf_dir, "li_nulls").repartition(int(cpus))) as p:
            rep = p.report()
        parts = [len(df.collect()) for df in rep.values()]
        return spark.createDataFrame([(len(parts), sum(parts))], "parts int, rows long")

    runners = dict(QUERIES, report_lineitem_full=full_report)
    for name in names:
        t0 = time.perf_counter()
        out = runners[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t0, 3)
        rows[name] = len(out)
        print(f"{name}: {times[name]}s ({rows[name]} rows)", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "rows": rows, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
