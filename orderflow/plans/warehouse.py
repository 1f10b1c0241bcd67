"""Star schema over the validated orders: three dimensions and one fact table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.dates import any_date, iso_date, quarter_label
from orderflow.functions.money import rounded_average, rounded_sum
from orderflow.plans.reports import REPORTS
from orderflow.sources import versions
from orderflow.sources.jobs import run_together

ORDERS = "validated_orders"


def dim_customer(orders: DataFrame) -> DataFrame:
    """Lifetime metrics per (customer, email)."""
    return orders.groupBy("customer_id", "customer_email").agg(
        F.count_distinct("order_id").alias("lifetime_orders"),
        rounded_sum(F.col("total_amount")).alias("lifetime_spend"),
    )


def dim_product(orders: DataFrame) -> DataFrame:
    """Price and frequency per (product, category)."""
    return orders.groupBy("product_id", "product_category").agg(
        rounded_average(F.col("unit_price")).alias("avg_unit_price"),
        F.count(F.lit(1)).alias("times_ordered"),
    )


def dim_date(orders: DataFrame) -> DataFrame:
    """Calendar parts per distinct date text; text that is not ISO has null parts."""
    day = iso_date(F.col("order_date"))
    return (
        orders.select("order_date")
        .distinct()
        .select(
            "order_date",
            F.year(day).alias("order_year"),
            F.month(day).alias("order_month"),
            F.day(day).alias("order_day"),
            quarter_label(F.month(day)).alias("order_quarter"),
        )
    )


def fact_orders(orders: DataFrame) -> DataFrame:
    """One row per order line."""
    return orders.select(
        "order_id",
        "customer_id",
        "product_id",
        "order_date",
        "region",
        "payment_method",
        "quantity",
        "unit_price",
        "total_amount",
    )


def order_date_normalized(orders: DataFrame) -> DataFrame:
    """Order lines with both date formats parsed to DATE."""
    return orders.withColumn("order_day", any_date(F.col("order_date")))


def dimension_key_check(dim: DataFrame, key: str) -> DataFrame:
    """Keys that own more than one row of a dimension."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("dim_rows")).where("dim_rows > 1")


# Build order of the warehouse tables.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dim_customer": dim_customer,
    "dim_product": dim_product,
    "dim_date": dim_date,
    "fact_orders": fact_orders,
}


def build_warehouse(orders: DataFrame, folder: str) -> dict[str, int]:
    """Publish every table, replacing earlier ones; rows written per table.

    ``orders`` is read once per table, each time only the columns the table needs, so
    it should be a written table.
    """

    def write(name: str) -> int:
        return versions.publish(TABLES[name](orders), f"{folder}/{name}")

    return run_together(orders.sparkSession, {n: lambda n=n: write(n) for n in TABLES})


def read_warehouse(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: versions.current(spark, f"{folder}/{name}") for name in TABLES}


def drop_warehouse(spark: SparkSession, folder: str) -> None:
    """Leave no table current; tables that are not there stay so."""
    for name in TABLES:
        versions.drop(spark, f"{folder}/{name}")


def register_warehouse(orders: DataFrame, tables: Mapping[str, DataFrame]) -> None:
    """Make tables and reporting views available to ``spark.sql``, replacing earlier ones."""
    for name, table in {ORDERS: orders, **tables}.items():
        table.createOrReplaceTempView(name)
    for name, build in REPORTS.items():
        build(tables).createOrReplaceTempView(f"vw_{name}")


def object_names() -> list[str]:
    return [ORDERS, *TABLES, *[f"vw_{name}" for name in REPORTS]]


#: What the session catalog calls the kinds of objects, and what they are here.
OBJECT_KINDS = {"MANAGED": "table", "EXTERNAL": "table", "VIEW": "view", "TEMPORARY": "temporary view"}


def warehouse_objects(spark: SparkSession) -> DataFrame:
    """(name, type, columns) of every table and view the session knows, by its catalog."""
    found = [
        (o.name, OBJECT_KINDS.get(o.tableType, o.tableType.lower()), len(spark.catalog.listColumns(o.name)))
        for o in spark.catalog.listTables()
    ]
    return spark.createDataFrame(found, "name string, type string, columns int")
