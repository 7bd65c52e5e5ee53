"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "route", "dense_knn", "bm25_search", "sparse_cosine_search", "pool_to_template_max", "rrf", "routing_summary", "extract_by_rules",
    "assemble_extraction", "semantic_dedup", "similarity_calibration", "intent_from_text", "scrub_text", "classify_log", "normalise_cases",
    "telemetry_per_minute", "audit_stats", "recent_k", "sync_catalog", "usage_rollup", "error_ratio_alert", "failure_counts",
    "latency_per_minute_stream", "breaker_timeline_stream",
]


def main() -> None:
    from waymark import plans
    from waymark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        master=f"local[{cpus}]", app="bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = plans.load()
    names = sys.argv[1:] or HEADLINE
    # one small query first, so that no query is charged for starting the session
    queries["audit_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
