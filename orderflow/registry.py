"""Every operator as a query over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.fixed_values import EXPECTED_TYPES, NA_TOKENS
from orderflow.functions.text import null_if_na
from orderflow.operators import clean, generate, profile, sampling, schema, validation
from orderflow.operators.rules import order_rules
from orderflow.plans import fixture, governance, lineage, reports, warehouse
from orderflow.plans.pipeline import STAGING, VALIDATED, WAREHOUSE, Pipeline
from orderflow.sources import files, versions
from orderflow.sources import lineage_log as log_files
from orderflow.sources.csv_files import read_csv, write_csv
from orderflow.sources.shared_folder import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_KEYS = ("order_id", "product_id", "quantity", "customer_id")

# Values written over regions by ``na_token_nulls``: every token and two look-alikes.
INJECTED = (*NA_TOKENS, "none", "-")

def rules() -> dict[str, Column]:
    return order_rules(fixture.FIXTURE_CATEGORIES)


_written: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Stage results are written once per session and state of the table folder, as the pipeline does."""
    key = (spark.sparkContext.applicationId, sf_dir, files.stamp(spark, sf_dir), name)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged raw orders."""
    return _once(
        spark, sf_dir, "raw", lambda: stage(fixture.raw_orders(spark, sf_dir), "raw_orders")
    )


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written validated orders."""
    return _once(
        spark,
        sf_dir,
        "validated",
        lambda: stage(clean.clean(raw(spark, sf_dir)), "validated_orders"),
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The written star schema."""

    def build() -> dict[str, DataFrame]:
        folder = new_folder(spark, "warehouse")
        warehouse.build_warehouse(validated(spark, sf_dir), folder)
        return warehouse.read_warehouse(spark, folder)

    return _once(spark, sf_dir, "tables", build)


def finished_run(spark: SparkSession, sf_dir: str) -> Pipeline:
    """A pipeline that ran over the raw orders from end to end."""

    def build() -> Pipeline:
        pipeline = Pipeline(
            spark, new_folder(spark, "run"), valid_categories=fixture.FIXTURE_CATEGORIES
        )
        pipeline.run(raw(spark, sf_dir))
        return pipeline

    return _once(spark, sf_dir, "run", build)


def on_raw(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(raw(spark, sf_dir))


def on_validated(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(validated(spark, sf_dir))


def on_tables(build: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(tables(spark, sf_dir))


def on_lineage(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(finished_run(spark, sf_dir).lineage())


def standardized_columns(orders: DataFrame) -> DataFrame:
    """Messy headers, one of them renamed by map, back to the plain names."""
    messy = orders.toDF(*[f" {c.replace('_', ' ').title()} " for c in orders.columns])
    renamed = messy.withColumnRenamed(" Order Id ", "InvoiceNo")
    return schema.standardize_columns(renamed, {"InvoiceNo": "order_id"})


def na_token_nulls(orders: DataFrame) -> DataFrame:
    """Regions overwritten with missing-value tokens, then nulled."""
    which = (F.col("order_id") + F.col("product_id")) % 30
    options = F.array(*[F.lit(t) for t in INJECTED])
    text = F.when(which < len(INJECTED), F.get(options, which.cast("int"))).otherwise(F.col("region"))
    return orders.select(
        "order_id", "product_id", text.alias("text")
    ).withColumn("value", null_if_na(F.col("text")))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write CSV with quotes and commas in the text, read it back, restore the types."""
    method = F.concat("payment_method", F.lit(', "'), F.coalesce("region", F.lit("")), F.lit('"'))
    path = new_folder(spark, "csv")
    write_csv(raw(spark, sf_dir).withColumn("payment_method", method), path)
    return schema.with_order_types(read_csv(spark, path))


def csv_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of which some have fields with line breaks, read back together."""
    folder = new_folder(spark, "csv")
    broken = F.col("order_id") % 50 == 3
    lines = raw(spark, sf_dir)
    write_csv(lines.where(~broken), f"{folder}/plain")
    with_breaks = F.concat("payment_method", F.lit('\n"'), F.col("order_date"), F.lit('"'))
    write_csv(lines.where(broken).withColumn("payment_method", with_breaks), f"{folder}/broken")
    return schema.with_order_types(read_csv(spark, f"{folder}/*"))


def damaged_text(orders: DataFrame) -> DataFrame:
    """All columns as text, with cells that change the type of three columns."""
    text = orders.select([F.col(c).cast("string") for c in orders.columns])
    odd = F.col("order_id").cast("bigint") % 100 == 3
    return text.withColumns(
        {
            "customer_id": F.when(odd, F.concat(F.lit("C"), F.col("customer_id"))).otherwise(F.col("customer_id")),
            "quantity": F.when(~odd, F.col("quantity")),
            "region": F.col("product_id"),
        }
    )


def schema_report(orders: DataFrame) -> DataFrame:
    return schema.schema_report(damaged_text(orders).drop("payment_method"), EXPECTED_TYPES)


def duplicate_count(orders: DataFrame) -> DataFrame:
    return profile.with_copies(orders).agg(
        F.sum(profile.COPIES).alias("rows"),
        F.sum(F.col(profile.COPIES) - 1).alias("later_duplicates"),
        F.sum(F.when(F.col(profile.COPIES) > 1, F.col(profile.COPIES)).otherwise(0)).alias("rows_in_duplicate_sets"),
    )


def recompute_fine_prices(orders: DataFrame) -> DataFrame:
    """Amounts of prices with eight decimals."""
    fine = F.col("unit_price") + (F.col("order_id") % 997) / F.lit(100000000.0)
    return clean.recompute_total_amount(orders.withColumn("unit_price", fine))


def without_products(orders: DataFrame) -> DataFrame:
    """Some lines without a product, the prices of most of them left."""
    return orders.withColumn("product_id", F.when(F.col("order_id") % 20 != 7, F.col("product_id")))


def lone_prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned orders and raw profile of a table with prices that lack a product."""

    def build() -> tuple[DataFrame, DataFrame]:
        path = new_folder(spark, "lone_prices")
        before = validation.profile_and_clean(without_products(raw(spark, sf_dir)), rules(), path)
        return versions.current(spark, path), before

    return _once(spark, sf_dir, "lone_prices", build)


def column_states(orders: DataFrame) -> DataFrame:
    """The columns of a complete table and of one that lacks two and has one more."""
    partial = orders.drop("region", "total_amount").withColumn("note", F.lit("x")).where("quantity > 0")
    return schema.column_states({"complete": orders, "partial": partial})


def rule_flag(name: str, *columns: str) -> Query:
    return on_raw(lambda orders: orders.select("order_id", "product_id", *columns, rules()[name].alias("valid")))


def global_median_price(orders: DataFrame) -> DataFrame:
    counts = clean.price_counts(orders)
    return clean.overall_median(counts, clean.product_fills(counts))


def quality_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.score_summary(
        profile.row_profile(raw(spark, sf_dir), rules()),
        profile.row_profile(validated(spark, sf_dir), rules()),
    )


def data_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_report(
        profile.cell_profile(raw(spark, sf_dir), rules()),
        profile.cell_profile(validated(spark, sf_dir), rules()),
    )


def report_row_counts(star: dict[str, DataFrame]) -> DataFrame:
    counts = None
    for name, build in reports.REPORTS.items():
        one = build(star).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("report"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def warehouse_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered tables and views, and the rows each holds."""
    run = finished_run(spark, sf_dir)
    warehouse.register_warehouse(run.read("staging/validated_orders"), run.tables())
    rows = None
    for name in warehouse.object_names():
        one = spark.sql(f"SELECT '{name}' AS name, count(*) AS rows FROM {name}")
        rows = one if rows is None else rows.unionByName(one)
    return warehouse.warehouse_objects(spark).join(rows, "name")


def validated_text_ids(orders: DataFrame) -> DataFrame:
    """The cleaning chain over ids that are text."""
    return clean.clean(
        orders.withColumns(
            {
                "order_id": F.concat(F.lit("C"), "order_id"),
                "customer_id": F.concat(F.lit("K"), "customer_id"),
                "product_id": F.concat("product_id", F.lit("A")),
            }
        )
    )


def lineage_extra(log: DataFrame) -> DataFrame:
    """What each stage noted about itself."""
    noted = F.from_json(
        "extra",
        "quality_score_before double, quality_score_after double, improvement_points double, "
        "duplicates_removed bigint, schema_type_mismatches array<string>, objects_created array<string>, "
        "files_exported array<string>",
    )
    scores = ("quality_score_before", "quality_score_after", "improvement_points", "duplicates_removed")
    lists = ("schema_type_mismatches", "objects_created", "files_exported")
    return log.select("stage", noted.alias("e")).select(
        "stage",
        *[F.col(f"e.{name}") for name in scores],
        *[F.when(F.col(f"e.{name}").isNotNull(), F.size(f"e.{name}")).alias(name) for name in lists],
    )


def catalog_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog that a run left as CSV, with the table each column's stage wrote to."""
    run = finished_run(spark, sf_dir)
    made = run.lineage().select(F.col("stage").alias("source_stage"), "target")
    return run.dictionary().join(made, "source_stage").select("table", "column", "data_type", "pii", "source_stage", "target")


def column_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog that a run left says of each column's making, with the nulls the column holds."""
    told = finished_run(spark, sf_dir).dictionary().select("table", "column", F.col("transformation_applied").alias("transformation"))
    return told.join(_held(spark, sf_dir), ["table", "column"])


def column_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns that the revenue of a category was made of, and what they hold."""
    held = _held(spark, sf_dir)
    found = lineage.upstream(governance.column_edges(governance.column_lineage(held)), "vw_category_performance.revenue")
    named = held.select(F.concat_ws(".", "table", "column").alias("ancestor"), "rows", "nulls")
    return found.join(named, "ancestor")


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that a run published: how often, and the rows of the last version."""
    run = finished_run(spark, sf_dir)
    found = None
    for name in (STAGING, VALIDATED, *[f"{WAREHOUSE}/{t}" for t in warehouse.TABLES]):
        published = versions.history(spark, run.path(name))
        one = published.agg(F.count("version").alias("versions"), F.max_by("rows", "number").alias("rows")).select(F.lit(name).alias("table"), "versions", "rows")
        found = one if found is None else found.unionByName(one)
    return found


def _logged_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every stage of a run was tried twice, the second time with a row more, and logged twice."""

    def build() -> str:
        path = new_folder(spark, "lineage_log")
        for r in finished_run(spark, sf_dir).lineage().collect():
            for attempt in (1, 2, 2):
                done = lineage.StageRun(r.run_id, r.stage, r.source, r.target, r.rows_in + attempt - 1, r.rows_out, attempt=attempt)
                done.log(spark, path)
            if r.stage != "04_generate_reports":
                log_files.compact(spark, path)
        return path

    return log_files.read_log(spark, _once(spark, sf_dir, "logged_again", build))


def lineage_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged_again(spark, sf_dir).select("stage", "attempt", "rows_in", "rows_out", "rows_dropped")


def run_violations(log: DataFrame) -> DataFrame:
    """What does not fit together in a whole log, and in two that are damaged."""
    numbers = log.withColumns({"run_id": F.lit("run 2"), "rows_in": F.col("rows_in") + 1})
    order = F.dense_rank().over(Window.orderBy("stage"))
    times = log.withColumns(
        {"run_id": F.lit("0000000f"), "timestamp": F.lit("2024-01-09").cast("timestamp") - F.make_interval(days=order), "source": F.upper("source")}
    )
    found = lineage.run_violations(log.unionByName(numbers).unionByName(times))
    return found.select(F.when(F.col("run_id").isin("run 2", "0000000f"), F.col("run_id")).otherwise("whole").alias("run"), "stage", "violation")


def lineage_log(log: DataFrame) -> DataFrame:
    return log.select("stage", "source", "target", "rows_in", "rows_out", "rows_dropped")


def lineage_log_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported CSV of the log, without the columns that differ between runs."""
    flat = read_csv(spark, finished_run(spark, sf_dir).path("reports/lineage_log_flat"))
    counts = [F.col(c).cast("bigint") for c in ("rows_in", "rows_out", "rows_dropped")]
    return flat.select("stage", "source", "target", *counts, "columns")


def generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic order for every order of the table, seeded by its key."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ids = keys.select((F.col("o_orderkey") + 1).alias("id"))
    return generate.dirty_orders(ids, keys.agg(F.count(F.lit(1))).scalar())


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and nulls of every column of every table and view."""
    star = tables(spark, sf_dir)
    views = {f"vw_{name}": make(star) for name, make in reports.REPORTS.items()}
    orders = {"raw_orders": raw(spark, sf_dir), "validated_orders": validated(spark, sf_dir)}
    return governance.column_profile(orders | star | views)


def catalog(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(governance.data_dictionary(spark), _held(spark, sf_dir))


def dimension_key_check(star: dict[str, DataFrame]) -> DataFrame:
    def check(table: str, key: str) -> DataFrame:
        rows = warehouse.dimension_key_check(star[table], key)
        return rows.select(F.lit(table).alias("dimension"), F.col(key).alias("key"), "dim_rows")

    return check("dim_customer", "customer_id").unionByName(check("dim_product", "product_id"))


def outliers(multiple: int) -> Query:
    return on_tables(lambda t: reports.anomalies_high_value_orders(t["fact_orders"], multiple))


QUERIES: dict[str, Query] = {
    "raw_orders": fixture.raw_orders,
    "standardized_columns": on_raw(standardized_columns),
    "na_token_nulls": on_raw(na_token_nulls),
    "csv_roundtrip": csv_roundtrip,
    "inferred_types": on_raw(lambda o: schema.inferred_types(damaged_text(o))),
    "schema_report": on_raw(schema_report),
    "null_audit": on_raw(lambda o: profile.null_audit(profile.cell_profile(o, rules()))),
    "duplicate_count": on_raw(duplicate_count),
    "duplicate_rows": on_raw(profile.duplicate_sets),
    "email_validity": rule_flag("email", "customer_email"),
    "category_validity": rule_flag("category", "product_category"),
    "quantity_validity": rule_flag("quantity", "quantity"),
    "price_validity": rule_flag("price", "unit_price"),
    "duplicate_members": on_raw(profile.duplicate_members),
    "row_issue_rows": on_raw(lambda o: profile.issue_rows(o, rules())),
    "recompute_total_amount_fine": on_raw(recompute_fine_prices),
    "validity_masks": on_raw(lambda o: profile.pass_shares(profile.cell_profile(o, rules()))),
    "row_issue_flag": on_raw(lambda o: profile.issue_share(profile.row_profile(o, rules()))),
    "quality_score_before": on_raw(lambda o: profile.quality_score(profile.row_profile(o, rules()))),
    "product_median_price": on_raw(clean.product_medians),
    "global_median_price": on_raw(global_median_price),
    "impute_unit_price": on_raw(clean.impute_unit_price),
    "fill_unknown": on_raw(clean.fill_unknown),
    "drop_null_email": on_raw(clean.drop_null_email),
    "deduplicate": on_raw(clean.deduplicate),
    "filter_positive": on_raw(clean.filter_positive),
    "title_case_category": on_raw(clean.title_case_category),
    "invalid_email_to_null": on_raw(clean.invalid_email_to_null),
    "recompute_total_amount": on_raw(clean.recompute_total_amount),
    "validated_orders": on_raw(clean.clean),
    "validated_orders_text_ids": on_raw(validated_text_ids),
    "quality_score_after": on_validated(
        lambda o: profile.quality_score(profile.row_profile(o, rules()))
    ),
    "quality_score_summary": quality_score_summary,
    "data_quality_report": data_quality_report,
    "dim_customer": on_validated(warehouse.dim_customer),
    "dim_product": on_validated(warehouse.dim_product),
    "dim_date": on_validated(warehouse.dim_date),
    "fact_orders": on_validated(warehouse.fact_orders),
    **{name: on_tables(build) for name, build in reports.REPORTS.items()},
    "anomalies_high_value_orders_k2": outliers(2),
    "report_row_counts": on_tables(report_row_counts),
    "warehouse_objects": warehouse_objects,
    "lineage_log": on_lineage(lineage_log),
    "lineage_columns": on_lineage(lambda log: lineage.lineage_columns(log).drop("run_id")),
    "lineage_edges": on_lineage(lambda log: lineage.lineage_edges(log).drop("last_run")),
    "lineage_upstream": on_lineage(lambda log: lineage.lineage_upstream(log, "reports")),
    "lineage_log_flat": lineage_log_flat,
    "lineage_extra": on_lineage(lineage_extra),
    "catalog_from_csv": catalog_from_csv,
    "csv_mixed_files": csv_mixed_files,
    "column_states": on_raw(column_states),
    "validated_orders_lone_prices": lambda spark, sf_dir: lone_prices(spark, sf_dir)[0],
    "quality_score_lone_prices": lambda spark, sf_dir: profile.quality_score(lone_prices(spark, sf_dir)[1]),
    "column_lineage": lambda spark, sf_dir: governance.lineage_with_nulls(_held(spark, sf_dir)),
    "column_upstream": column_upstream,
    "column_transformations": column_transformations,
    "table_versions": table_versions,
    "lineage_attempts": lineage_attempts,
    "run_violations": on_lineage(run_violations),
    "generated_orders": generated_orders,
    "sample_rows": on_raw(lambda o: sampling.sample_rows(o, SAMPLE_KEYS, 150)),
    "sample_fraction": on_raw(lambda o: sampling.sample_fraction(o, SAMPLE_KEYS, 0.04)),
    "data_dictionary": catalog(governance.documented_columns),
    "pii_columns": catalog(governance.pii_columns),
    "dictionary_coverage": catalog(governance.undocumented_columns),
    "order_date_normalized": on_validated(warehouse.order_date_normalized),
    "monthly_revenue_normalized": on_tables(
        lambda t: reports.monthly_revenue_normalized(t["fact_orders"])
    ),
    "category_performance_exact": on_validated(reports.category_performance_exact),
    "dimension_key_check": on_tables(dimension_key_check),
}
