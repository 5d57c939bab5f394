"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

#: One query of each group of operators.
HEADLINES = (
    "confirmed_intervals", "rm01_natr14", "rm06_abs_trend_t20", "sc01_strict_past_percentile", "sc04_dimension_scores", "st03_nested_states", "cf03_intervals",
    "dq09_quality_summary", "dq14_gap_intervals", "ez05_event_zones", "ez20_asof_daily", "as04_correlation_pooled", "as18_lag_profile", "nm08_null_summary",
    "dy05_joint_intervals", "dy09_path_metrics", "rc02_keyed_diff",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelwright import catalog

    found, seconds = catalog.queries(), {}
    found["rc07_max_share"](spark, sf_dir).collect()  # start-up of the session is not measured
    for name in HEADLINES:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
