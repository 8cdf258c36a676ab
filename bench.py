"""Headline queries timed one by one from the input files; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.plans import feed_queries  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "normalized_vectors",
    "consensus_at_time",
    "latest_market_rows",
    "latency_percentiles",
    "dispatch_order",
    "replay_hashes",
    "score_classes",
    "consensus_trace",
    "risk_decisions",
    "normalized_odds",
)


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tidemark-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    queries = feed_queries.queries()
    spark.range(10).count()
    timings: dict[str, float] = {}
    for name in HEADLINES:
        feed_queries.forget()  # every query pays for all it needs
        start = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "feed_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
