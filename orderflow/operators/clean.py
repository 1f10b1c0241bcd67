"""Cleaning steps, DataFrame -> DataFrame, and their fixed order.

The order is part of the result: medians are taken before bad rows leave, copies are
dropped while the old amounts are still in place, categories are re-spelled after that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.fixed_values import BAD_EMAIL_LITERAL, UNKNOWN
from orderflow.functions.money import line_amount
from orderflow.functions.text import is_email, strip_whitespace, title_case
from orderflow.operators import repeats
from orderflow.operators.median import median_of_counts
from orderflow.sources.shared_folder import stage


def fill_unknown(df: DataFrame) -> DataFrame:
    return df.fillna({"product_category": UNKNOWN, "region": UNKNOWN})


def price_counts(df: DataFrame) -> DataFrame:
    """How often each product has each price; no price and no product count as values.

    A (product, price) may come several times. Most rows are of no use to the fills, so whoever reads them leaves
    those out first and sums up the rest.
    """
    return df.select("product_id", "unit_price", F.lit(1).cast("bigint").alias("n"))


def _summed(counts: DataFrame) -> DataFrame:
    return stage(counts.groupBy("product_id", "unit_price").agg(F.sum("n").alias("n")), "price_counts")


def _known_products(counts: DataFrame) -> DataFrame:
    return counts.where("product_id is not null")


def product_medians(df: DataFrame) -> DataFrame:
    """(product_id, median) of the prices present, copies and bad prices included."""
    counts = _summed(_known_products(price_counts(df)))
    return median_of_counts(counts, ["product_id"], "unit_price", "n")


@dataclass(frozen=True)
class PriceFills:
    """Prices to put where none is.

    ``by_product`` has a row for each product that lacks a price somewhere, null if it
    has none anywhere; ``missing`` counts the places. ``overall`` is one row, the median
    of the column once the products are filled, or nothing where no row needs it.
    """

    by_product: DataFrame
    overall: DataFrame | None


def overall_median(counts: DataFrame, by_product: DataFrame) -> DataFrame:
    """(median) of all prices, those filled per product included."""
    filled = _known_products(counts).select("unit_price", "n").unionByName(
        by_product.select(F.col("fill_price").alias("unit_price"), F.col("missing").alias("n"))
    )
    return median_of_counts(filled, [], "unit_price", "n")


def product_fills(counts: DataFrame) -> DataFrame:
    """(product_id, missing, fill_price) of the products that lack a price somewhere; only their prices are shuffled."""
    known = _known_products(counts)
    without = known.where("unit_price is null").groupBy("product_id").agg(F.sum("n").alias("missing"))
    missing = stage(without, "price_missing")
    prices = _summed(repeats.among(known.where("unit_price is not null"), missing, "product_id"))
    medians = median_of_counts(prices, ["product_id"], "unit_price", "n")
    fills = missing.join(medians.withColumnRenamed("median", "fill_price"), "product_id", "left")
    return stage(fills, "price_fills")


def price_fills(counts: DataFrame) -> PriceFills:
    """Compute the fills from the price counts, read several times; they are written to the shared folder."""
    by_product = product_fills(counts)
    unfilled = by_product.where("fill_price is null").select("product_id")
    needs_overall = unfilled.unionByName(counts.where("product_id is null").select("product_id"))
    overall = None
    if not needs_overall.isEmpty():
        overall = stage(overall_median(counts, by_product), "price_overall")
    return PriceFills(by_product, overall)


def impute_unit_price(df: DataFrame, fills: PriceFills | None = None) -> DataFrame:
    """Product median where the price is missing, overall median where that is too.

    A row without a product gets the overall median even if it has a price. Only the rows that lack
    a price meet the fills: a second scan is cheaper than shuffling every row, Spark chooses the
    join by the written sizes, and AQE splits a product that is hot there.
    """
    fills = fills or price_fills(price_counts(df))
    by_product = fills.by_product.select("product_id", "fill_price")
    overall = fills.overall.scalar() if fills.overall else F.lit(None)
    columns = [F.col(f"`{c}`") for c in df.columns]

    def fill(part: DataFrame, found: Column) -> DataFrame:
        price = F.when(F.col("product_id").isNotNull(), F.coalesce(F.col("unit_price"), found))
        return part.withColumn("unit_price", F.coalesce(price, overall)).select(columns)

    needs_product_fill = F.col("unit_price").isNull() & F.col("product_id").isNotNull()
    joined = df.where(needs_product_fill).join(by_product, "product_id", "left")
    return fill(df.where(~needs_product_fill), F.lit(None)).unionByName(fill(joined, F.col("fill_price")))


def drop_null_email(df: DataFrame) -> DataFrame:
    return df.where("customer_email is not null")


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each set of rows equal in every column; nulls equal nulls. Rows without an equal stay where they are."""
    alone, others = repeats.split(df)
    return alone.union(others.dropDuplicates())


def filter_positive(df: DataFrame) -> DataFrame:
    """quantity > 0 and price > 0; NaN, which Spark orders above every number, fails."""
    return df.where("quantity > 0 and unit_price > 0 and not isnan(unit_price)")


def title_case_category(df: DataFrame) -> DataFrame:
    return df.withColumn("product_category", title_case(strip_whitespace(F.col("product_category"))))


def invalid_email_to_null(df: DataFrame, mode: str = "literal") -> DataFrame:
    """Null the known bad literal, or with ``mode="regex"`` every malformed address."""
    email = F.col("customer_email")
    if mode == "regex":
        return df.withColumn("customer_email", F.when(is_email(email), email))
    return df.withColumn("customer_email", F.nullif(email, F.lit(BAD_EMAIL_LITERAL)))


def recompute_total_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("total_amount", line_amount(F.col("quantity"), F.col("unit_price")))


def finish(df: DataFrame, email_mode: str = "literal") -> DataFrame:
    """Row rules after the copies are gone."""
    return (
        df.transform(filter_positive)
        .transform(title_case_category)
        .transform(invalid_email_to_null, email_mode)
        .transform(drop_null_email)
        .transform(recompute_total_amount)
    )


def clean(
    df: DataFrame, fills: PriceFills | None = None, email_mode: str = "literal"
) -> DataFrame:
    """The whole chain."""
    return (
        df.transform(fill_unknown)
        .transform(impute_unit_price, fills)
        .transform(drop_null_email)
        .transform(deduplicate)
        .transform(finish, email_mode)
    )
