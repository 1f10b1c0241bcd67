"""Dirty orders derived from the provided star-schema tables.

Every defect is a function of integer keys, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.money import line_amount
from orderflow.operators.schema import ORDER_COLUMNS

# Categories of the part table that count as valid.
FIXTURE_CATEGORIES = ("economy", "large", "medium", "promo", "small", "standard")


def _between(bucket: Column, first: int, last: int) -> Column:
    return (bucket >= first) & (bucket <= last)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with injected nulls, copies, bad values and mixed date formats."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    places = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    # Orders and lines both grow with the data: always a shuffle join. The other sides
    # are broadcast only if Spark finds them small. Parts come first: where they are not,
    # the lines are shuffled twice, and so before they have the columns of their orders.
    lines = (
        table("lineitem")
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    order, part, supp, line = (
        F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
    hashed = lines.withColumns(
        {
            "h1": (order * 31 + part * 17 + line * 7) % 1000,
            "h2": (order * 13 + part * 29 + supp * 3) % 1000,
            "h3": (order * 7 + supp * 37 + line * 11) % 1000,
        }
    )
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    category, quantity = F.col("p_type"), F.col("l_quantity").cast("bigint")
    cents = F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity"))
    dirty = hashed.select(
        order.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(h1 < 40, None)
        .when(h1 < 45, "not-an-email")
        .when(h1 < 48, "broken@nodot")
        .otherwise(F.concat(F.lit("customer"), F.col("o_custkey"), F.lit("@example.com")))
        .alias("customer_email"),
        part.alias("product_id"),
        F.when(h2 < 20, None)
        .when(h2 < 220, F.lower(category))
        .when(h2 < 240, F.concat(F.lit(" "), category, F.lit(" ")))
        .when(h2 < 250, "men's wear")
        .otherwise(category)
        .alias("product_category"),
        F.when(h3 < 8, -quantity).otherwise(quantity).alias("quantity"),
        F.when(_between(h3, 100, 109), None)
        .when(_between(h3, 110, 112), -1.0)
        .otherwise(cents / F.lit(100.0))
        .alias("unit_price"),
        F.when(order % 7 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(_between(h2, 300, 314), None).otherwise(F.col("r_name")).alias("region"),
        F.col("o_orderpriority").alias("payment_method"),
        # A duplicated row is emitted twice here, instead of joining everything again.
        F.explode(
            F.when(_between(h2, 500, 529), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ).alias("_copy"),
    )
    amount = line_amount(F.col("quantity"), F.col("unit_price"))
    return dirty.withColumn("total_amount", amount).select(*ORDER_COLUMNS)
