"""Literals the results depend on, stated once and in one place."""

# Expected order schema: column -> inferred type name.
EXPECTED_TYPES = {
    "order_id": "int64",
    "customer_id": "int64",
    "customer_email": "object",
    "product_id": "int64",
    "product_category": "object",
    "quantity": "int64",
    "unit_price": "float64",
    "order_date": "object",
    "region": "object",
    "payment_method": "object",
    "total_amount": "float64",
}

# An email has one @, no whitespace, and a dot somewhere after the @.
# (?dU): only \n ends a line, and \s covers Unicode whitespace. \x1c-\x1f are
# whitespace by the expected rule but not in Java's Unicode class.
EMAIL_PATTERN = r"(?dU)^[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]+$"

# Emails removed by cleaning, compared literally.
BAD_EMAIL_LITERAL = "not-an-email"

# Replacement for a missing category or region.
UNKNOWN = "Unknown"

# Lower-case category names accepted by the category rule.
VALID_CATEGORIES = (
    "electronics",
    "clothing",
    "home & kitchen",
    "books",
    "toys",
    "sports",
)

# Text cells that mean "missing" in a CSV file.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Outlier cut: an order above this multiple of the mean order value.
OUTLIER_MULTIPLE = 3

# Length of the customer ranking.
TOP_CUSTOMERS = 10

# Stage names written to the lineage log.
STAGE_INGEST = "01_ingest"
STAGE_VALIDATE = "02_validate"
STAGE_TRANSFORM = "03_transform"
STAGE_REPORTS = "04_generate_reports"

# Fixed values of a lineage record: its fields and their types.
LINEAGE_FIELDS = (
    ("run_id", "string"),
    ("stage", "string"),
    ("timestamp", "timestamp"),
    ("source", "string"),
    ("target", "string"),
    ("rows_in", "bigint"),
    ("rows_out", "bigint"),
    ("rows_dropped", "bigint"),
    ("columns", "array<string>"),
    ("transformation", "string"),
    ("extra", "string"),
)

# Fixed values of a column catalog kept as CSV: its headers.
CATALOG_HEADERS = (
    "table",
    "column",
    "data_type",
    "description",
    "source_stage",
    "transformation_applied",
    "pii",
)

# Value lists and rates of the synthetic order generator.
SYNTHETIC_CATEGORIES = (
    "Electronics",
    "electronics",
    "Clothing",
    "clothing",
    "Home & Kitchen",
    "Books",
    "Toys",
    "Sports",
)
SYNTHETIC_REGIONS = ("North", "South", "East", "West", "Central")
SYNTHETIC_PAYMENT_METHODS = (
    "Credit Card",
    "Debit Card",
    "UPI",
    "Net Banking",
    "COD",
)
SYNTHETIC_ROWS = 5000
SYNTHETIC_FIRST_DAY = "2023-01-01"
SYNTHETIC_LAST_DAY_OFFSET = 730

# Fixed values of the documented columns: table, column, type, stage, personal data.
# Column * stands for the whole table; personal data is yes, no or mixed.
DOCUMENTED = (
    ("raw_orders", "order_id", "int", STAGE_INGEST, "no"),
    ("raw_orders", "customer_id", "int", STAGE_INGEST, "no"),
    ("raw_orders", "customer_email", "string", STAGE_INGEST, "yes"),
    ("raw_orders", "product_id", "int", STAGE_INGEST, "no"),
    ("raw_orders", "product_category", "string", STAGE_INGEST, "no"),
    ("raw_orders", "quantity", "int", STAGE_INGEST, "no"),
    ("raw_orders", "unit_price", "float", STAGE_INGEST, "no"),
    ("raw_orders", "order_date", "string", STAGE_INGEST, "no"),
    ("raw_orders", "region", "string", STAGE_INGEST, "no"),
    ("raw_orders", "payment_method", "string", STAGE_INGEST, "no"),
    ("raw_orders", "total_amount", "float", STAGE_INGEST, "no"),
    ("validated_orders", "*", "*", STAGE_VALIDATE, "mixed"),
    ("dim_customer", "customer_id", "int", STAGE_TRANSFORM, "no"),
    ("dim_customer", "lifetime_orders", "int", STAGE_TRANSFORM, "no"),
    ("dim_customer", "lifetime_spend", "float", STAGE_TRANSFORM, "no"),
    ("dim_product", "product_id", "int", STAGE_TRANSFORM, "no"),
    ("dim_product", "avg_unit_price", "float", STAGE_TRANSFORM, "no"),
    ("dim_date", "order_date", "string", STAGE_TRANSFORM, "no"),
    ("fact_orders", "order_id", "int", STAGE_TRANSFORM, "no"),
    ("fact_orders", "total_amount", "float", STAGE_TRANSFORM, "no"),
    ("vw_monthly_revenue", "total_revenue", "float", STAGE_REPORTS, "no"),
    ("vw_category_performance", "revenue", "float", STAGE_REPORTS, "no"),
    ("vw_anomalies_amount_mismatch", "*", "*", STAGE_REPORTS, "no"),
    ("vw_anomalies_high_value_orders", "*", "*", STAGE_REPORTS, "no"),
)
