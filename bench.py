"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads),
BENCH_QUERIES (comma list, or "all"), BENCH_RUNS (timed runs per query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fleetlens.catalog import QUERIES
from fleetlens.session import build_session

HEADLINE = (
    "read_offers", "offer_quality_filter", "price_summary", "top_offers", "estimate",
    "scaling_table", "assign_offers", "hybrid_split", "assign_items_to_shards", "read_instances_paged",
    "normalize_instances", "enumerate_instances", "owned_instances", "verify_ownership", "zombie_candidates",
    "cleanup_dispatch", "sweep_report", "destroy_verdict", "read_batch_state", "migrate_state_v0", "batch_cost",
    "current_spend", "archivable_batches", "unit_current_state", "retry_verdict", "spend_crossings", "deploy_outcome",
    "remaining_items", "expiring_objects", "chunk_plan", "missing_predictions", "upload_unresolved",
    "prediction_status", "overlapping_rules", "lifecycle_plan", "rules_after", "unit_action_stream",
    "dead_recheck", "cycle_summary", "gpu_health", "run_workload",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = sorted(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus, driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        samples = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    result = {
        "metric": "total of headline query medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
