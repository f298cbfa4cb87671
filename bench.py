"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wirebook.plans.catalog import QUERIES  # noqa: E402
from wirebook.session import configure  # noqa: E402

HEADLINES = [
    "recent_failures", "trace_id_page_order", "filter_url_ci", "view_redact_sensitive", "store_page",
    "session_status", "view_char_boundary", "agent_ingest", "fault_coverage", "pair_requests",
    "http1_exchanges", "http2_streams",
]
WARM_UP_DIR = "/root/testdata/sf0.001"


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("wirebook-bench"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # A first run on the smallest tables lets the JVM compile the code; it is not timed.
    if os.path.isdir(WARM_UP_DIR):
        for name in HEADLINES:
            run(spark, name, WARM_UP_DIR)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINES}
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
