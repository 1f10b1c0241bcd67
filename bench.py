"""Time the headline queries and the pipeline; print one JSON line.

Every result is written in full to a sink that discards it, so nothing is pruned and
nothing passes through the driver. Stages and pipeline write their tables as usual.
Each entry runs twice: ``queries`` holds the second time, ``first_run`` the one that
also loads and compiles classes.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from orderflow import registry
from orderflow.plans import fixture
from orderflow.plans.pipeline import Pipeline
from orderflow.sources.shared_folder import new_folder, stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "null_audit",
    "validity_masks",
    "quality_score_before",
    "product_median_price",
    "impute_unit_price",
    "deduplicate",
    "title_case_category",
    "validated_orders",
    "quality_score_after",
    "quality_score_summary",
    "dim_customer",
    "dim_product",
    "dim_date",
    "monthly_revenue",
    "category_performance",
    "region_performance",
    "top_customers",
    "anomalies_amount_mismatch",
    "anomalies_high_value_orders",
    "csv_roundtrip",
    "schema_report",
    "generated_orders",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("orderflow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    first: dict[str, float] = {}
    seconds: dict[str, float] = {}

    def timed(name, run):
        for times in (first, seconds):
            start = time.perf_counter()
            result = run()
            times[name] = round(time.perf_counter() - start, 3)
        return result

    def consume(name):
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    def run_pipeline():
        folder = new_folder(spark, "bench")
        Pipeline(spark, folder, valid_categories=fixture.FIXTURE_CATEGORIES).run(raw)

    raw = timed("stage_raw_orders", lambda: stage(fixture.raw_orders(spark, SF_DIR), "raw_orders"))
    timed("pipeline", run_pipeline)
    for build in (registry.raw, registry.validated, registry.tables):
        build(spark, SF_DIR)
    for name in HEADLINES:
        timed(name, lambda n=name: consume(n))
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": raw.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
