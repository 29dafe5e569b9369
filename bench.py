"""Headline queries at BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from hourloom.catalog import QUERIES
from hourloom.session import local_session

HEADLINE = [
    "ts_clean_pipeline",
    "ts_interpolate_by_user",
    "win_features_full",
    "win_features_by_user",
    "agg_metrics_by_model",
    "agg_quantile_events",
    "ev_dm_hac",
    "ev_calibration_curve",
    "ml_conformal",
    "fc_recursive",
    "bt_walk_forward",
    "bt_walk_forward_linear",
    "bt_recursive_reanchored",
    "registry_current",
    "ml_sarima_fit",
    "fc_request_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the first run warms up planning and code generation
            start = time.perf_counter()
            # The noop sink evaluates every column without moving rows to the driver.
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
