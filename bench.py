"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.catalog import load  # noqa: E402
from shelfwise.session import tuned  # noqa: E402

HEADLINE = [
    "top10_live", "gate_failures", "rescore_changed", "lookup_terms", "lifecycle_sweep", "own_offer_matches", "own_offer_top5",
    "comparison_products", "breakdown_grouping_sets", "simulate_scenarios", "regional_products", "shrinkflation", "weekly_trend",
    "competitor_overview", "bi_feed", "product_resolution", "identity_match", "lineage", "canonical_fold", "validation_split",
    "local_range_parse", "payload_status", "content_dedup", "alert_episodes", "extraction_quality", "stream_weekly_activity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (tuned(SparkSession.builder.appName("shelfwise-bench")).master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = load().queries, {}
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executors; not a query's time
    for name in names:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "shelfwise_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
