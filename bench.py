"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fieldpanel.plans import catalog

HEADLINE = [
    "clean_rules",
    "clean_rule_counts",
    "survey_long",
    "window_match_16",
    "label_thresholds",
    "quality_shares",
    "corr_by_age",
    "train_rows",
    "group_folds",
    "metrics_by_group",
    "roc_curve",
    "average_precision",
    "norm_stats",
    "history_long",
    "history_len",
    "sequences",
    "sequence_summary",
    "padded",
    "linear_contributions",
    "rf_oof",
    "perm_importance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run starts the JVM's compilers and the readers.
    catalog.QUERIES["clean_rule_counts"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
