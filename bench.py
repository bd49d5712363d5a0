"""Time the headline queries: python bench.py prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query is run once cold and then BENCH_RUNS times (default 2); the best
warm time counts. Results go to the no-op sink, so all rows and columns are made.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from batchloom.plans import load_catalog  # noqa: E402
from batchloom.session import builder  # noqa: E402

HEADLINE = [
    "batch_rollup", "health_score", "error_patterns", "assign_chunks", "page_results", "page_results_deep",
    "cache_split_missing", "enrich_with_cache", "export_results_csv", "retention_preview", "cascade_delete_old",
    "recent_errors", "export_multi", "batch_status", "phone_flag", "normalize_response", "append_results",
    "sustained_alerts", "latency_report", "stream_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalog().QUERIES

    def once(name: str) -> float:
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(once(name), 3)
        warm[name] = round(min(once(name) for _ in range(runs)), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "result_rows": rows,
        "rollup_urls_per_minute": round(rows / warm["batch_rollup"] * 60),
        "enrich_urls_per_minute": round(rows / warm["enrich_with_cache"] * 60),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
