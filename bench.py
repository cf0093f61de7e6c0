"""Time the headline queries and print one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from verification.queries import QUERIES

HEADLINE = (
    "profile_nulls", "profile_distinct", "profile_distinct_documents", "profile_minmax", "infer_types", "sample_values",
    "duplicate_count", "dedupe", "quality_score", "to_numeric_safe", "parse_dates", "cleaning_plan", "impute_median",
    "impute_mode", "standardize_case", "drop_outliers", "apply_safe_plan", "apply_full_plan", "cleaning_summary",
    "describe", "quantile_search", "group_means", "categorical_columns", "trend_stats", "pearson_pairs", "welch_t",
    "anova_f", "ranked_findings", "ranked_findings_lineitem", "findings_after_cleaning", "line_series",
    "scatter_trendline", "csv_load", "json_load",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of columns in error messages are not needed here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # The no-op sink runs the whole plan without the cost of moving rows to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
