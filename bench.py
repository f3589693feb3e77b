"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from kinsight.plans import catalogue

HEADLINE = (
    "w01_sessions_30", "w01_account_sessions_480", "f03_cluster_features", "f05_normalised_features", "a03_device_profiles", "p16_personas", "r04_top_genres",
    "j01_event_session", "a06_households", "h09_merged_entities", "m15_hybrid_attribution", "m18_touch_credit", "m07_coalition_values", "dr05_composition", "e08_calibration", "t01_region_revenue",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, taken = catalogue.queries(), {}
    for name in [n for n in HEADLINE if n in queries]:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        taken[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
