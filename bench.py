"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from pollgauge.plans import load_queries
from pollgauge.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "detect_jump", "detect_frozen", "detect_stale", "collection_profile", "continuity_segments", "period_census",
    "build_features", "score", "critical_station_hours", "exposure_bins", "collection_health", "longest_repeat_streak",
    "roc_auc", "tau_costs", "injection_grid", "end_to_end", "evaluate_experiment", "two_way_anova", "bootstrap_ci",
    "permutation_interaction", "answer_rates", "stream_periods", "stream_jump",
    "supplier_daily_lags", "customer_order_steps",
)


def main() -> None:
    spark = local_session(CPUS)
    queries = load_queries()
    queries["critical_flag"].run(spark, SF_DIR).count()  # start the JVM's code paths
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
