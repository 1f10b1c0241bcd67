"""Reporting views over the star schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.fixed_values import OUTLIER_MULTIPLE, TOP_CUSTOMERS
from orderflow.functions.dates import any_date
from orderflow.functions.money import amount_differs, from_cents, rounded_sum, sum_cents
from orderflow.sources.counted import write_counted
from orderflow.sources.csv_files import write_csv
from orderflow.sources.jobs import run_together


def _monthly(lines: DataFrame) -> DataFrame:
    """Sums are added up before they move, so that only months and order ids are shuffled to be told apart."""
    month = ["order_year", "order_month"]
    revenue = lines.groupBy(*month).agg(rounded_sum(F.col("total_amount")).alias("total_revenue"))
    orders = lines.select(*month, "order_id").distinct().groupBy(*month).agg(F.count("order_id").alias("total_orders"))
    both = revenue.unionByName(orders, allowMissingColumns=True).groupBy(*month)
    return both.agg(F.max("total_revenue").alias("total_revenue"), F.max("total_orders").alias("total_orders")).orderBy(*month)


def monthly_revenue(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Revenue and distinct orders per month; unparsed dates share a null month.

    The date dimension has one row per date text. Spark broadcasts it by its file
    size, which a calendar keeps small, and otherwise sorts and splits hot dates.
    """
    return _monthly(fact.join(dates, "order_date"))


def monthly_revenue_normalized(fact: DataFrame) -> DataFrame:
    """The same with DD/MM/YYYY dates parsed, so they land in their own month."""
    day = any_date(F.col("order_date"))
    return _monthly(
        fact.where("order_date is not null").select(
            F.year(day).alias("order_year"),
            F.month(day).alias("order_month"),
            "order_id",
            "total_amount",
        )
    )


def category_performance(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Orders, units and revenue per category, through the product dimension.

    A product with several categories counts under each of them. Lines are summed per
    product before the join, so a popular product joins as one row and the fan-out
    never multiplies order lines.
    """
    per_product = fact.groupBy("product_id").agg(
        F.count("order_id").alias("orders"),
        F.sum("quantity").alias("units_sold"),
        sum_cents(F.col("total_amount")).alias("cents"),
    )
    return (
        per_product.join(products.select("product_id", "product_category"), "product_id")
        .groupBy("product_category")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("units_sold").alias("units_sold"),
            from_cents(F.sum("cents")).alias("revenue"),
        )
        .orderBy(F.desc("revenue"))
    )


def category_performance_exact(orders: DataFrame) -> DataFrame:
    """The same without fan-out: every order line counts once."""
    return (
        orders.groupBy("product_category")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("quantity").alias("units_sold"),
            rounded_sum(F.col("total_amount")).alias("revenue"),
        )
        .orderBy(F.desc("revenue"))
    )


def region_performance(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("region")
        .agg(
            F.count("order_id").alias("orders"),
            rounded_sum(F.col("total_amount")).alias("revenue"),
        )
        .orderBy(F.desc("revenue"))
    )


def top_customers(customers: DataFrame, k: int = TOP_CUSTOMERS) -> DataFrame:
    """The k rows with the highest spend; ties go to the lower id, then email."""
    return (
        customers.select("customer_id", "customer_email", "lifetime_orders", "lifetime_spend")
        .orderBy(F.desc("lifetime_spend"), "customer_id", "customer_email")
        .limit(k)
    )


def anomalies_amount_mismatch(fact: DataFrame) -> DataFrame:
    """Lines whose amount is not quantity x price."""
    return fact.where(
        amount_differs(F.col("quantity"), F.col("unit_price"), F.col("total_amount"))
    )


def anomalies_high_value_orders(fact: DataFrame, multiple: float = OUTLIER_MULTIPLE) -> DataFrame:
    """Lines above a multiple of the mean amount, highest first.

    The ids after the amount keep a very common amount from sorting in one task.
    """
    amount = F.col("total_amount")
    mean = F.try_divide(rounded_sum(amount), F.count(amount).cast("double"))
    threshold = fact.agg((mean * float(multiple)).alias("threshold"))
    return fact.where(amount > threshold.scalar()).orderBy(
        F.desc("total_amount"), "order_id", "product_id", "customer_id", "quantity"
    )


Tables = Mapping[str, DataFrame]

# Report name -> plan over the warehouse tables.
REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "monthly_revenue": lambda t: monthly_revenue(t["fact_orders"], t["dim_date"]),
    "category_performance": lambda t: category_performance(t["fact_orders"], t["dim_product"]),
    "region_performance": lambda t: region_performance(t["fact_orders"]),
    "top_customers": lambda t: top_customers(t["dim_customer"]),
    "anomalies_amount_mismatch": lambda t: anomalies_amount_mismatch(t["fact_orders"]),
    "anomalies_high_value_orders": lambda t: anomalies_high_value_orders(t["fact_orders"]),
}


def export_reports(tables: Tables, folder: str) -> dict[str, int]:
    """Write one CSV folder per report; rows per report."""

    def export(name: str) -> int:
        return write_counted(REPORTS[name](tables), lambda d: write_csv(d, f"{folder}/{name}"))

    spark = tables["fact_orders"].sparkSession
    return run_together(spark, {n: lambda n=n: export(n) for n in REPORTS})
