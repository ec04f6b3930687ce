"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Every query is run to a
sink that takes all rows, after one warm-up query that starts the engine.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks import QUERIES

HEADLINE = [
    "scope_classify", "counter_fold", "direction_pivot", "first_sight",
    "proc_fields", "project_root", "normalize_cmdline", "resolve_chain", "tgid_lifetime",
    "identity_upsert", "surrogate_id", "attributed_minutes", "top_exe_of_week",
    "minute_merge", "rollup_hour", "rollup_day", "rollup_month", "prune_retention",
    "tier_sink", "tier_scan", "tier_constraints",
    "top_by_identity", "top_by_project", "top_by_exe", "top_by_user", "series",
    "uid_scope", "unresolved_share", "counter_rows", "window_answer", "rollup_watermark", "stream_minute_fold",
    "stream_ingest", "stream_watch", "late_samples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bytewake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["positive_bytes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
