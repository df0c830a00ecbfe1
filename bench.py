"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from traceloom.plans import registry
from traceloom.session import build_session

HEADLINE = (
    "src_01_trace_scan", "val_06_redact_text", "join_01_exact_clusters", "join_05_near_duplicates",
    "join_06_accept_in_order", "row_04_scores", "agg_08_measured_experiment", "val_16_outcomes",
    "agg_09_cell_report", "top_06_cheapest_acceptable", "top_07_trial_plan", "top_03_option_order",
    "ds_09_join_14_ranking_rows", "agg_13_routing_evaluation", "agg_19_calibration_report",
    "agg_24_execution_metrics", "agg_29_bootstrap_means", "agg_35_method_summary",
    "row_22_reference_overlap", "win_05_health_rules", "win_07_next_action_examples",
    "spl_01_group_split", "join_10_clean_splits", "join_19_top_02_workflow_routes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = registry()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in names:
        plan, _ = known[name]
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
