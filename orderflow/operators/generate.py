"""Synthetic dirty orders, generated by the executors.

Each value is a deterministic draw from the row's id, so any partitioning and any
retry yields the same table. Defect rates are those of a base table of
``SYNTHETIC_ROWS`` rows. Defects are drawn independently of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.fixed_values import (
    BAD_EMAIL_LITERAL,
    SYNTHETIC_CATEGORIES,
    SYNTHETIC_FIRST_DAY,
    SYNTHETIC_LAST_DAY_OFFSET,
    SYNTHETIC_PAYMENT_METHODS,
    SYNTHETIC_REGIONS,
    SYNTHETIC_ROWS,
)
from orderflow.functions.draws import draw_below, draw_one, hits
from orderflow.functions.money import line_amount
from orderflow.operators.schema import ORDER_COLUMNS

# Missing share per column, then copies and bad cells per 5,000 base rows.
MISSING_EMAIL = 0.04
MISSING_CATEGORY = 0.02
MISSING_REGION = 0.015
MISSING_PRICE = 0.01
COPIES = 150 / SYNTHETIC_ROWS
NEGATIVE_QUANTITIES = 40 / (SYNTHETIC_ROWS + 150)
MALFORMED_EMAILS = 25 / (SYNTHETIC_ROWS + 150)
NEGATIVE_PRICES = 15 / (SYNTHETIC_ROWS + 150)


def clean_orders(ids: DataFrame, rows: Column) -> DataFrame:
    """One flawless order per id 1..rows, dates spread evenly over the calendar."""
    i = F.col("id")
    step = F.floor((i - 1) * SYNTHETIC_LAST_DAY_OFFSET / F.greatest(rows - 1, F.lit(1)))
    day = F.date_add(F.lit(SYNTHETIC_FIRST_DAY).cast("date"), step.cast("int"))
    customer = draw_below(i, 1, 500) + 1000
    return ids.select(
        i.alias("order_id"),
        customer.alias("customer_id"),
        F.concat(F.lit("customer"), customer, F.lit("@example.com")).alias("customer_email"),
        (draw_below(i, 2, 160) + 100).alias("product_id"),
        draw_one(i, 3, SYNTHETIC_CATEGORIES).alias("product_category"),
        (draw_below(i, 4, 9) + 1).alias("quantity"),
        ((draw_below(i, 5, 49501) + 500) / F.lit(100.0)).alias("unit_price"),
        F.when((i - 1) % 7 == 0, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("order_date"),
        draw_one(i, 6, SYNTHETIC_REGIONS).alias("region"),
        draw_one(i, 7, SYNTHETIC_PAYMENT_METHODS).alias("payment_method"),
    )


def with_nulls(df: DataFrame) -> DataFrame:
    """Blank out a share of four columns."""
    i = F.col("order_id")
    blanks = {
        "customer_email": hits(i, 11, MISSING_EMAIL),
        "product_category": hits(i, 12, MISSING_CATEGORY),
        "region": hits(i, 13, MISSING_REGION),
        "unit_price": hits(i, 14, MISSING_PRICE),
    }
    return df.withColumns({c: F.when(~blank, F.col(c)) for c, blank in blanks.items()})


def with_copies(df: DataFrame) -> DataFrame:
    """Append exact copies of a share of the rows, told apart by ``_copy``."""
    copies = df.where(hits(F.col("order_id"), 15, COPIES))
    return df.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))


def with_bad_values(df: DataFrame) -> DataFrame:
    """Negative quantities, malformed emails and negative prices, per row and copy."""
    row = F.col("order_id") * 2 + F.col("_copy")
    quantity, email, price = F.col("quantity"), F.col("customer_email"), F.col("unit_price")
    return df.withColumns(
        {
            "quantity": F.when(hits(row, 16, NEGATIVE_QUANTITIES), -quantity).otherwise(quantity),
            "customer_email": F.when(
                hits(row, 17, MALFORMED_EMAILS), BAD_EMAIL_LITERAL
            ).otherwise(email),
            "unit_price": F.when(hits(row, 18, NEGATIVE_PRICES), -1.0).otherwise(price),
        }
    )


def dirty_orders(ids: DataFrame, rows: Column) -> DataFrame:
    """A raw order table over the given ids; the amount follows the damaged values."""
    damaged = clean_orders(ids, rows).transform(with_nulls).transform(with_copies)
    damaged = damaged.transform(with_bad_values)
    amount = line_amount(F.col("quantity"), F.col("unit_price"))
    return damaged.withColumn("total_amount", amount).select(*ORDER_COLUMNS)


def generate_orders(spark: SparkSession, rows: int = SYNTHETIC_ROWS) -> DataFrame:
    """A raw order table of ``rows`` base rows and some copies."""
    return dirty_orders(spark.range(1, rows + 1), F.lit(rows))
