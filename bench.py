"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

# area -> query, in the order of an end-to-end run
HEADLINE = [
    "segment_growth_panel", "curated_build", "merged_series", "quarterly_by_rule", "series_check", "lag_features", "metric_table",
    "model_comparison", "real_time_weights", "calibrated_intervals", "coverage_table", "heldout_comparison",
    "bootstrap_rmse_gap", "price_fan", "stressed_exposures", "estimated_rule", "majority_vote", "split_audit",
    "lead_lag_correlations", "predictive_lag_screen", "variance_inflation", "tuned_elastic_nets", "snapshot_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from panelcast.plans import QUERIES
    from panelcast.session import local_session

    spark = local_session(cpus, "panelcast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start Python workers and load classes outside the timings
    spark.read.parquet(f"{sf_dir}/region.parquet").mapInPandas(lambda it: it, "r_regionkey int, r_name string").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
