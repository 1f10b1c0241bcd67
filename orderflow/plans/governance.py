"""The column catalog: what is documented, what is personal, what the tables hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from orderflow.fixed_values import CATALOG_HEADERS, DOCUMENTED
from orderflow.sources.csv_files import read_csv

DICTIONARY_SCHEMA = ", ".join(f"`{name}` string" for name in CATALOG_HEADERS)

PERSONAL = ("customer_email",)

#: What a column means, wherever it occurs.
MEANING = {
    "order_id": "which order a line belongs to",
    "customer_id": "who bought",
    "customer_email": "how to write to the buyer; lines without one do not survive cleaning",
    "product_id": "what was bought",
    "product_category": "kind of product, spelled alike once cleaned",
    "quantity": "pieces bought, positive once cleaned",
    "unit_price": "price a piece, imputed where it was missing",
    "order_date": "day of purchase in the spelling it came in",
    "region": "where it was sold, Unknown where that was missing",
    "payment_method": "means of payment",
    "total_amount": "pieces times price, in two decimals",
    "lifetime_orders": "different orders of a buyer at one address",
    "lifetime_spend": "all amounts of a buyer at one address",
    "avg_unit_price": "mean price over the lines of a product",
    "times_ordered": "lines of a product",
    "order_year": "year of an ISO date",
    "order_month": "month of an ISO date",
    "order_day": "day of the month of an ISO date",
    "order_quarter": "quarter of the month; Q4 for other dates",
    "total_revenue": "amounts of a month",
    "total_orders": "different orders of a month",
    "orders": "lines of the group",
    "units_sold": "pieces of the group",
    "revenue": "amounts of the group",
}


def _type_name(kind: T.DataType) -> str:
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return "int" if whole else "float" if isinstance(kind, (T.DoubleType, T.FloatType)) else kind.simpleString()


#: How a column of a table comes about: (sources, what is done to them). Sources name a table of the run;
#: columns that are not here are taken over from the column of the same name.
MADE = {
    ("validated_orders", "customer_email"): (("raw_orders.customer_email",), "lines without an address or with the placeholder leave"),
    ("validated_orders", "product_category"): (("raw_orders.product_category",), "Unknown where missing; outer spaces off; words capitalized"),
    ("validated_orders", "quantity"): (("raw_orders.quantity",), "lines of 0 pieces or less leave"),
    ("validated_orders", "unit_price"): (
        ("raw_orders.unit_price", "raw_orders.product_id"), "median of the product where missing, else the median of all; lines at 0 or less leave",
    ),
    ("validated_orders", "region"): (("raw_orders.region",), "Unknown where missing"),
    ("validated_orders", "total_amount"): (("raw_orders.quantity", "raw_orders.unit_price"), "pieces times price after cleaning, in two decimals"),
    ("dim_customer", "lifetime_orders"): (("validated_orders.order_id",), "different values per customer and address"),
    ("dim_customer", "lifetime_spend"): (("validated_orders.total_amount",), "sum per customer and address"),
    ("dim_product", "avg_unit_price"): (("validated_orders.unit_price",), "mean per product and category"),
    ("dim_product", "times_ordered"): (("validated_orders.product_id",), "lines per product and category"),
    ("dim_date", "order_year"): (("validated_orders.order_date",), "year of an ISO date"),
    ("dim_date", "order_month"): (("validated_orders.order_date",), "month of an ISO date"),
    ("dim_date", "order_day"): (("validated_orders.order_date",), "day of an ISO date"),
    ("dim_date", "order_quarter"): (("validated_orders.order_date",), "quarter of an ISO date, Q4 for other dates"),
    ("vw_monthly_revenue", "order_year"): (("dim_date.order_year",), "group"),
    ("vw_monthly_revenue", "order_month"): (("dim_date.order_month",), "group"),
    ("vw_monthly_revenue", "total_revenue"): (("fact_orders.total_amount",), "sum per month"),
    ("vw_monthly_revenue", "total_orders"): (("fact_orders.order_id",), "different values per month"),
    ("vw_category_performance", "product_category"): (("dim_product.product_category",), "group"),
    ("vw_category_performance", "orders"): (("fact_orders.order_id",), "lines per category"),
    ("vw_category_performance", "units_sold"): (("fact_orders.quantity",), "sum per category"),
    ("vw_category_performance", "revenue"): (("fact_orders.total_amount",), "sum per category"),
    ("vw_region_performance", "region"): (("fact_orders.region",), "group"),
    ("vw_region_performance", "orders"): (("fact_orders.order_id",), "lines per region"),
    ("vw_region_performance", "revenue"): (("fact_orders.total_amount",), "sum per region"),
}

#: The table that columns of the same name are taken over from.
TAKEN_FROM = {
    "validated_orders": "raw_orders",
    "dim_customer": "validated_orders",
    "dim_product": "validated_orders",
    "dim_date": "validated_orders",
    "fact_orders": "validated_orders",
    "vw_top_customers": "dim_customer",
    "vw_anomalies_amount_mismatch": "fact_orders",
    "vw_anomalies_high_value_orders": "fact_orders",
}

KEPT = "taken over"


def _made(table: str, column: str) -> tuple[tuple[str, ...], str]:
    if (table, column) in MADE:
        return MADE[table, column]
    return ((f"{TAKEN_FROM[table]}.{column}",), KEPT) if table in TAKEN_FROM else ((), "as it came in")


def column_lineage(profile: DataFrame) -> DataFrame:
    """(table, column, source_table, source_column, transformation) of every column of a profile.

    A column that came in from outside has no row.
    """
    steps = [(t, c, *s.split("."), how) for (t, c), (sources, how) in MADE.items() for s in sources]
    schema = "table string, column string, source_table string, source_column string, transformation string"
    declared = profile.sparkSession.createDataFrame(steps, schema)
    own = profile.select("table", "column").distinct()
    told = own.join(declared, ["table", "column"])
    rest = own.join(declared, ["table", "column"], "left_anti")
    origin = F.create_map(*[F.lit(x) for item in TAKEN_FROM.items() for x in item])[F.col("table")]
    taken = rest.where(origin.isNotNull()).select(
        "table", "column", origin.alias("source_table"), F.col("column").alias("source_column"), F.lit(KEPT).alias("transformation")
    )
    return told.unionByName(taken)


def column_edges(lineage: DataFrame) -> DataFrame:
    """(source, target) of columns as ``table.column``: fit for ``plans.lineage.upstream``."""
    return lineage.select(
        F.concat_ws(".", "source_table", "source_column").alias("source"), F.concat_ws(".", "table", "column").alias("target")
    )


def lineage_with_nulls(profile: DataFrame) -> DataFrame:
    """The column lineage with the nulls of each source and result: what a step did to missing cells."""
    source = profile.select(F.col("table").alias("source_table"), F.col("column").alias("source_column"), F.col("nulls").alias("source_nulls"))
    return column_lineage(profile).join(source, ["source_table", "source_column"]).join(profile.drop("rows"), ["table", "column"]).select(
        "table", "column", "source_table", "source_column", "transformation", "source_nulls", "nulls"
    )


def column_catalog(spark: SparkSession, held: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Every column of the tables of each stage, as their schemas have it."""
    rows = [
        (table, f.name, _type_name(f.dataType), MEANING.get(f.name, ""), made_by, _made(table, f.name)[1], "yes" if f.name in PERSONAL else "no")
        for made_by, tables in held.items()
        for table, df in tables.items()
        for f in df.schema
    ]
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)


def data_dictionary(spark: SparkSession) -> DataFrame:
    """The documented columns that a given catalog lists."""
    return spark.createDataFrame(DOCUMENTED, "table string, column string, data_type string, source_stage string, pii string")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A catalog kept as CSV, its columns found by their headers, in any order.

    Unknown headers stop, and so does a catalog that does not name table and column; of the others
    those that are not there are null.
    """
    held = read_csv(spark, path)
    by_name = {c.strip().lower(): c for c in held.columns}
    unknown = sorted(set(by_name) - set(CATALOG_HEADERS))
    missing = [c for c in CATALOG_HEADERS[:2] if c not in by_name]
    if unknown or missing or len(by_name) < len(held.columns):
        raise ValueError(f"no column catalog: unknown headers {unknown}, missing {missing}, all {held.columns}")
    return held.select([F.col(f"`{by_name[c]}`").alias(c) if c in by_name else F.lit(None).cast("string").alias(c) for c in CATALOG_HEADERS])


def column_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, rows, nulls) of every column: one aggregate per table."""
    profiles = None
    for name, df in tables.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls:{c}") for c in df.columns],
        )
        named = counts.withColumnsRenamed({f"nulls:{c}": c for c in df.columns})
        long = named.unpivot(["rows"], list(df.columns), "column", "nulls").select(
            F.lit(name).alias("table"), "column", "rows", "nulls"
        )
        profiles = long if profiles is None else profiles.unionByName(long)
    return profiles


def _documents(dictionary: DataFrame, profile: DataFrame):
    return (dictionary["table"] == profile["table"]) & (
        dictionary["column"].isin("*") | (dictionary["column"] == profile["column"])
    )


def documented_columns(dictionary: DataFrame, profile: DataFrame) -> DataFrame:
    """Catalog entries of the columns that exist, with what the columns hold."""
    return profile.join(dictionary, _documents(dictionary, profile)).select(
        profile["table"], profile["column"], "data_type", "pii", "source_stage", "rows", "nulls"
    )


def pii_columns(dictionary: DataFrame, profile: DataFrame) -> DataFrame:
    """Columns that hold or may hold personal data."""
    return documented_columns(dictionary, profile).where("pii != 'no'")


def undocumented_columns(dictionary: DataFrame, profile: DataFrame) -> DataFrame:
    """Columns of the tables that no catalog entry covers."""
    return profile.join(dictionary, _documents(dictionary, profile), "left_anti")
