"""The same results in plain SQL, for an engine that shares no code with the jobs.

The texts only name the provided tables. They restate the rules of the order fixture and
of the cleaning chain; nothing here is built from the DataFrame code.
"""

from __future__ import annotations

import re

from orderflow.fixed_values import (
    DOCUMENTED, EXPECTED_TYPES, NA_TOKENS, SYNTHETIC_CATEGORIES, SYNTHETIC_PAYMENT_METHODS, SYNTHETIC_REGIONS,
)

COLUMNS = tuple(EXPECTED_TYPES)

EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"
CATEGORIES = "('economy', 'large', 'medium', 'promo', 'small', 'standard')"

AMOUNT = (
    "CAST(round_even(CAST(quantity AS DECIMAL(10,0)) * CAST(unit_price AS DECIMAL(28,10)), 2) AS DOUBLE)"
)

RAW = f"""
hashed AS (
  SELECT *,
    (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 AS h1,
    (l_orderkey * 13 + l_partkey * 29 + l_suppkey * 3) % 1000 AS h2,
    (l_orderkey * 7 + l_suppkey * 37 + l_linenumber * 11) % 1000 AS h3
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
dirty AS (
  SELECT
    l_orderkey AS order_id,
    o_custkey AS customer_id,
    CASE WHEN h1 < 40 THEN NULL WHEN h1 < 45 THEN 'not-an-email' WHEN h1 < 48 THEN 'broken@nodot'
         ELSE 'customer' || o_custkey || '@example.com' END AS customer_email,
    l_partkey AS product_id,
    CASE WHEN h2 < 20 THEN NULL WHEN h2 < 220 THEN lower(p_type) WHEN h2 < 240 THEN ' ' || p_type || ' '
         WHEN h2 < 250 THEN 'men''s wear' ELSE p_type END AS product_category,
    CASE WHEN h3 < 8 THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS quantity,
    CASE WHEN h3 BETWEEN 100 AND 109 THEN NULL WHEN h3 BETWEEN 110 AND 112 THEN -1.0e0
         ELSE floor(round(l_extendedprice * 100) / l_quantity) / 100.0e0 END AS unit_price,
    CASE WHEN l_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN h2 BETWEEN 300 AND 314 THEN NULL ELSE r_name END AS region,
    o_orderpriority AS payment_method,
    h2
  FROM hashed
),
priced AS (SELECT *, {AMOUNT} AS total_amount FROM dirty),
raw_orders AS (
  SELECT * EXCLUDE (h2) FROM priced
  UNION ALL
  SELECT * EXCLUDE (h2) FROM priced WHERE h2 BETWEEN 500 AND 529
)"""

TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), "
    "lambda w: upper(w[1]) || lower(w[2:])), '')"
)

MEDIANS = """
medians AS (
  SELECT product_id, median(unit_price) AS median FROM raw_orders
  WHERE product_id IS NOT NULL GROUP BY product_id
),
group_filled AS (
  SELECT r.* REPLACE (CASE WHEN r.product_id IS NOT NULL
                      THEN coalesce(r.unit_price, m.median) END AS unit_price)
  FROM raw_orders r LEFT JOIN medians m ON r.product_id = m.product_id
),
imputed AS (
  SELECT * REPLACE (coalesce(unit_price, (SELECT median(unit_price) FROM group_filled)) AS unit_price)
  FROM group_filled
)"""

VALIDATED = f"""{MEDIANS},
distinct_orders AS (
  SELECT DISTINCT * FROM (
    SELECT * REPLACE (coalesce(product_category, 'Unknown') AS product_category,
                      coalesce(region, 'Unknown') AS region)
    FROM imputed WHERE customer_email IS NOT NULL)
),
respelled AS (
  SELECT * REPLACE ({TITLE.format("trim(product_category)")} AS product_category)
  FROM distinct_orders
  WHERE quantity > 0 AND unit_price > 0 AND customer_email <> 'not-an-email'
),
validated_orders AS (SELECT * REPLACE ({AMOUNT} AS total_amount) FROM respelled)"""

MONEY_SUM = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"

STAR = f"""{VALIDATED},
fact_orders AS (
  SELECT order_id, customer_id, product_id, order_date, region, payment_method,
         quantity, unit_price, total_amount FROM validated_orders
),
dim_customer AS (
  SELECT customer_id, customer_email, count(DISTINCT order_id) AS lifetime_orders,
         {MONEY_SUM.format("total_amount")} AS lifetime_spend
  FROM validated_orders GROUP BY customer_id, customer_email
),
price_totals AS (
  SELECT product_id, product_category, count(*) AS n,
         sum(CAST(round(unit_price * 1000) AS BIGINT)) AS thousandths
  FROM validated_orders GROUP BY product_id, product_category
),
dim_product AS (
  SELECT product_id, product_category,
         CAST((thousandths * 2 + n * 10) // (n * 20) AS DOUBLE) / 100.0e0 AS avg_unit_price,
         n AS times_ordered
  FROM price_totals
),
dim_date AS (
  SELECT order_date,
         CAST(year(d) AS INTEGER) AS order_year, CAST(month(d) AS INTEGER) AS order_month,
         CAST(day(d) AS INTEGER) AS order_day,
         CASE WHEN month(d) IN (1, 2, 3) THEN 'Q1' WHEN month(d) IN (4, 5, 6) THEN 'Q2'
              WHEN month(d) IN (7, 8, 9) THEN 'Q3' ELSE 'Q4' END AS order_quarter
  FROM (SELECT DISTINCT order_date, CAST(try_strptime(order_date, '%Y-%m-%d') AS DATE) AS d
        FROM validated_orders)
),
vw_monthly_revenue AS (
  SELECT order_year, order_month, {MONEY_SUM.format("total_amount")} AS total_revenue,
         count(DISTINCT order_id) AS total_orders
  FROM fact_orders JOIN dim_date USING (order_date) GROUP BY order_year, order_month
),
vw_category_performance AS (
  SELECT product_category, count(order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units_sold,
         {MONEY_SUM.format("total_amount")} AS revenue
  FROM fact_orders JOIN dim_product USING (product_id) GROUP BY product_category
),
vw_region_performance AS (
  SELECT region, count(order_id) AS orders, {MONEY_SUM.format("total_amount")} AS revenue
  FROM fact_orders GROUP BY region
),
vw_top_customers AS (
  SELECT * FROM dim_customer ORDER BY lifetime_spend DESC, customer_id, customer_email LIMIT 10
),
vw_anomalies_amount_mismatch AS (
  SELECT * FROM fact_orders
  WHERE round(CAST(quantity AS DECIMAL(18,0)) * CAST(unit_price AS DECIMAL(18,4)), 2)
        <> round(CAST(total_amount AS DECIMAL(18,4)), 2)
),
vw_anomalies_high_value_orders AS (
  SELECT * FROM fact_orders WHERE total_amount > (
    SELECT {MONEY_SUM.format("total_amount")} / count(total_amount) * 3.0e0 FROM fact_orders)
)"""

REPORTS = (
    "monthly_revenue", "category_performance", "region_performance", "top_customers",
    "anomalies_amount_mismatch", "anomalies_high_value_orders",
)


def _with(chain: str, select: str) -> str:
    return f"WITH {chain.strip()}\n{select.strip()}"


def _raw(select: str) -> str:
    return _with(RAW, select)


def _validated(select: str) -> str:
    return _with(f"{RAW},{VALIDATED}", select)


def _star(select: str) -> str:
    return _with(f"{RAW},{STAR}", select)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _valid(rule: str) -> str:
    return {
        "email": f"regexp_matches(coalesce(customer_email, ''), {EMAIL})",
        "quantity": "coalesce(quantity > 0, false)",
        "price": "coalesce(unit_price > 0, false)",
        "category": f"lower(coalesce(product_category, '')) IN {CATEGORIES}",
    }[rule]


RULES = ("email", "quantity", "price", "category")


def _counts(table: str) -> str:
    """One row of counts and ratios for a table of the chain."""
    any_null = " OR ".join(f"{c} IS NULL" for c in COLUMNS)
    any_failed = " OR ".join(f"NOT {_valid(r)}" for r in RULES)
    null_cells = " + ".join(f"count(*) - count({c})" for c in COLUMNS)
    shares = " + ".join(f"avg(CAST({_valid(r)} AS INTEGER))" for r in RULES)
    return f"""
    SELECT count(*) AS n, sum(CAST(nth > 1 AS INTEGER)) AS dups,
           sum(CAST(members > 1 OR {any_null} OR {any_failed} AS INTEGER)) AS issues,
           1 - ({null_cells}) / (count(*) * {len(COLUMNS)}) AS completeness,
           1 - sum(CAST(nth > 1 AS INTEGER)) / count(*) AS uniqueness,
           ({shares}) / {len(RULES)} AS validity
    FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(COLUMNS)}) AS nth,
                    count(*) OVER (PARTITION BY {", ".join(COLUMNS)}) AS members FROM {table})"""


def _score(table: str) -> str:
    """One row of score and parts for a table of the chain."""
    return f"""
  SELECT CAST(n AS BIGINT) AS rows, CAST(dups AS BIGINT) AS later_duplicates,
         round(issues / n * 100, 2) AS issue_pct,
         round((completeness + uniqueness + validity) / 3 * 100, 2) AS quality_score,
         round(completeness * 100, 2) AS completeness_pct,
         round(uniqueness * 100, 2) AS uniqueness_pct, round(validity * 100, 2) AS validity_pct
  FROM ({_counts(table)})"""


def _summary() -> str:
    metrics = {
        "quality_score_before": "b.quality_score",
        "quality_score_after": "a.quality_score",
        "improvement_points": "round(a.quality_score - b.quality_score, 2)",
        "pct_rows_with_any_issue_before": "b.issue_pct",
        "pct_rows_with_any_issue_after": "0.0e0",
        "pct_rows_with_any_issue_after_actual": "a.issue_pct",
        "duplicate_rows_removed": "b.later_duplicates",
        "rows_before": "b.rows",
        "rows_after": "a.rows",
        "rows_dropped_total": "b.rows - a.rows",
        "completeness_before_pct": "b.completeness_pct",
        "completeness_after_pct": "a.completeness_pct",
        "uniqueness_before_pct": "b.uniqueness_pct",
        "uniqueness_after_pct": "a.uniqueness_pct",
        "validity_before_pct": "b.validity_pct",
        "validity_after_pct": "a.validity_pct",
    }
    rows = [f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM b, a" for m, v in metrics.items()]
    scores = f"b AS ({_score('raw_orders')}), a AS ({_score('validated_orders')})"
    return _with(f"{RAW},{VALIDATED}, {scores}", _union(rows))


def _null_counts(table: str) -> str:
    return _union(
        [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM {table}" for c in COLUMNS]
    )


# Damaged text used by the type queries: three columns change type.
DAMAGED = """
damaged AS (
  SELECT CAST(order_id AS VARCHAR) AS order_id,
         CASE WHEN order_id % 100 = 3 THEN 'C' || customer_id ELSE CAST(customer_id AS VARCHAR) END AS customer_id,
         customer_email, CAST(product_id AS VARCHAR) AS product_id, product_category,
         CASE WHEN order_id % 100 <> 3 THEN CAST(quantity AS VARCHAR) END AS quantity,
         CAST(unit_price AS VARCHAR) AS unit_price, order_date,
         CAST(product_id AS VARCHAR) AS region, payment_method,
         CAST(total_amount AS VARCHAR) AS total_amount
  FROM raw_orders
)"""


def _types(columns: tuple[str, ...]) -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", CASE
  WHEN count({c}) = 0 THEN 'float64'
  WHEN count({c}) = count(*) AND bool_and(regexp_full_match({c}, '[+-]?[0-9]+')) THEN 'int64'
  WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+(\\.[0-9]*)?(e[+-]?[0-9]+)?')) THEN 'float64'
  ELSE 'object' END AS inferred_type FROM damaged"""
            for c in columns
        ]
    )


def _schema_report() -> str:
    expected = ", ".join(f"('{c}', '{t}')" for c, t in EXPECTED_TYPES.items())
    present = tuple(c for c in COLUMNS if c != "payment_method")
    return _with(
        f"{RAW},{DAMAGED}, inferred AS ({_types(present)}), "
        f'expected AS (SELECT * FROM (VALUES {expected}) t("column", expected))',
        """SELECT "column", expected, coalesce(inferred_type, 'missing') AS actual
FROM expected LEFT JOIN inferred USING ("column")
WHERE inferred_type IS NULL OR expected <> inferred_type""",
    )


def _na_tokens() -> str:
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return _raw(
        f"""SELECT order_id, product_id, text,
  CASE WHEN text IN ({tokens}) THEN NULL ELSE text END AS value
FROM (SELECT order_id, product_id,
        CASE WHEN (order_id + product_id) % 30 < 21
             THEN ([{tokens}, 'none', '-'])[(order_id + product_id) % 30 + 1]
             ELSE region END AS text FROM raw_orders)"""
    )


def _report_counts() -> str:
    return _union([f"SELECT '{r}' AS report, count(*) AS rows FROM vw_{r}" for r in REPORTS])


def _lineage(columns: str = "") -> str:
    """Stage rows; the counts come from the chain."""
    names = '["' + '","'.join(COLUMNS) + '"]'
    stages = (
        ("01_ingest", "raw/raw_orders", "staging/staging_orders", "raw_rows", "raw_rows", names),
        ("02_validate", "staging/staging_orders", "staging/validated_orders", "raw_rows", "good_rows", names),
        ("03_transform", "staging/validated_orders", "warehouse", "good_rows", "fact_rows", names),
        ("04_generate_reports", "warehouse", "reports", "report_rows", "report_rows", "[]"),
    )
    rows = [
        f"SELECT '{s}' AS stage, '{a}' AS source, '{b}' AS target, "
        f"CAST({i} AS BIGINT) AS rows_in, CAST({o} AS BIGINT) AS rows_out, "
        f"CAST({i} - {o} AS BIGINT) AS rows_dropped, '{c}' AS columns FROM totals"
        for s, a, b, i, o, c in stages
    ]
    return f"""totals AS (
  SELECT (SELECT count(*) FROM raw_orders) AS raw_rows,
         (SELECT count(*) FROM validated_orders) AS good_rows,
         (SELECT count(*) FROM fact_orders) AS fact_rows,
         (SELECT sum(rows) FROM ({_report_counts()})) AS report_rows
),
stages AS ({_union(rows)})"""


def _on_lineage(select: str) -> str:
    return _with(f"{RAW},{STAR},\n{_lineage()}", select)


def _draw(key: str, salt: int) -> str:
    x = f"((({key}) % 2147483647 * {48271 + 1000003 * salt} + (({key}) >> 31) * 69621 + {12345 + salt}) % 2147483647)"
    square = f"({x} * {x} % 2147483647)"
    return f"({square} * {square} % 2147483647 * {x} % 2147483647)"


def _hits(key: str, salt: int, fraction: float) -> str:
    return f"{_draw(key, salt)} < {round(fraction * 2147483647)}"


def _pick(key: str, salt: int, choices: tuple[str, ...]) -> str:
    options = ", ".join(f"'{c}'" for c in choices)
    return f"([{options}])[{_draw(key, salt)} % {len(choices)} + 1]"


def _generated() -> str:
    row = "order_id * 2 + copy"
    return f"""WITH ids AS (SELECT o_orderkey + 1 AS id, count(*) OVER () AS n FROM orders),
spread AS (
  SELECT *, DATE '2023-01-01' + CAST(floor((id - 1) * 730 / greatest(n - 1, 1)) AS INTEGER) AS d,
         1000 + {_draw("id", 1)} % 500 AS customer FROM ids
),
base AS (
  SELECT id AS order_id, customer AS customer_id,
    CASE WHEN NOT {_hits("id", 11, 0.04)} THEN 'customer' || customer || '@example.com' END AS customer_email,
    100 + {_draw("id", 2)} % 160 AS product_id,
    CASE WHEN NOT {_hits("id", 12, 0.02)} THEN {_pick("id", 3, SYNTHETIC_CATEGORIES)} END AS product_category,
    1 + {_draw("id", 4)} % 9 AS quantity,
    CASE WHEN NOT {_hits("id", 14, 0.01)} THEN (500 + {_draw("id", 5)} % 49501) / 100.0e0 END AS unit_price,
    CASE WHEN (id - 1) % 7 = 0 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%Y-%m-%d') END AS order_date,
    CASE WHEN NOT {_hits("id", 13, 0.015)} THEN {_pick("id", 6, SYNTHETIC_REGIONS)} END AS region,
    {_pick("id", 7, SYNTHETIC_PAYMENT_METHODS)} AS payment_method
  FROM spread
),
copied AS (
  SELECT *, 0 AS copy FROM base
  UNION ALL SELECT *, 1 AS copy FROM base WHERE {_hits("order_id", 15, 150 / 5000)}
),
damaged AS (
  SELECT * EXCLUDE (copy) REPLACE (
    CASE WHEN {_hits(row, 16, 40 / 5150)} THEN -quantity ELSE quantity END AS quantity,
    CASE WHEN {_hits(row, 17, 25 / 5150)} THEN 'not-an-email' ELSE customer_email END AS customer_email,
    CASE WHEN {_hits(row, 18, 15 / 5150)} THEN -1.0e0 ELSE unit_price END AS unit_price)
  FROM copied
)
SELECT *, {AMOUNT} AS total_amount FROM damaged"""


def _sample_chain() -> str:
    """Weight the key columns into one key and draw from it."""
    names = ("order_id", "product_id", "quantity", "customer_id")
    key = " + ".join(f"abs({c}) % 2147483647 * {1 + 131071 * i}" for i, c in enumerate(names))
    return f"""{RAW},
keyed AS (SELECT *, {key} AS key FROM raw_orders),
drawn AS (SELECT * EXCLUDE (key), {_draw("key", 101)} AS draw FROM keyed)"""


def _sample(select: str) -> str:
    return _with(_sample_chain(), select)


# Lines without a product, most of them with a price.
LONE = RAW.replace("raw_orders AS (", "all_orders AS (") + """,
raw_orders AS (SELECT * REPLACE (CASE WHEN order_id % 20 <> 7 THEN product_id END AS product_id) FROM all_orders)"""

# Documented columns with their types, personal-data flags and stages.
DICTIONARY = ", ".join(f"('{t}', '{c}', '{kind}', '{pii}', '{made}')" for t, c, kind, made, pii in DOCUMENTED)

FACT_COLUMNS = (
    "order_id", "customer_id", "product_id", "order_date", "region", "payment_method", "quantity",
    "unit_price", "total_amount",
)
TABLE_COLUMNS = {
    "raw_orders": COLUMNS,
    "validated_orders": COLUMNS,
    "dim_customer": ("customer_id", "customer_email", "lifetime_orders", "lifetime_spend"),
    "dim_product": ("product_id", "product_category", "avg_unit_price", "times_ordered"),
    "dim_date": ("order_date", "order_year", "order_month", "order_day", "order_quarter"),
    "fact_orders": FACT_COLUMNS,
    "vw_monthly_revenue": ("order_year", "order_month", "total_revenue", "total_orders"),
    "vw_category_performance": ("product_category", "orders", "units_sold", "revenue"),
    "vw_region_performance": ("region", "orders", "revenue"),
    "vw_top_customers": ("customer_id", "customer_email", "lifetime_orders", "lifetime_spend"),
    "vw_anomalies_amount_mismatch": FACT_COLUMNS,
    "vw_anomalies_high_value_orders": FACT_COLUMNS,
}


def _catalog(select: str) -> str:
    held = _union(
        [
            f"SELECT '{t}' AS \"table\", \"column\", rows, rows - n AS nulls FROM (UNPIVOT ("
            f"SELECT count(*) AS rows, {', '.join(f'count({c}) AS {c}' for c in columns)} FROM {t}) "
            f"ON {', '.join(columns)} INTO NAME \"column\" VALUE n)"
            for t, columns in TABLE_COLUMNS.items()
        ]
    )
    chain = re.sub(r"\b(raw_orders|validated_orders|fact_orders) AS \(", r"\1 AS MATERIALIZED (", f"{RAW},{STAR}")
    return _with(
        f"{chain}, held AS MATERIALIZED ({held}), "
        f'dictionary AS (SELECT * FROM (VALUES {DICTIONARY}) t("table", entry, data_type, pii, source_stage)), '
        'documented AS MATERIALIZED (SELECT held."table", held."column", data_type, pii, source_stage, rows, nulls '
        'FROM held JOIN dictionary d ON held."table" = d."table" '
        "AND (d.entry = '*' OR d.entry = held.\"column\"))",
        select,
    )


# How columns are made: result table and columns, source table and columns, what is done.
STEPS = (
    ("validated_orders", "order_id customer_id product_id order_date payment_method", "raw_orders", "", "taken over"),
    ("validated_orders", "customer_email", "raw_orders", "", "lines without an address or with the placeholder leave"),
    ("validated_orders", "product_category", "raw_orders", "", "Unknown where missing; outer spaces off; words capitalized"),
    ("validated_orders", "quantity", "raw_orders", "", "lines of 0 pieces or less leave"),
    ("validated_orders", "unit_price", "raw_orders", "unit_price product_id",
     "median of the product where missing, else the median of all; lines at 0 or less leave"),
    ("validated_orders", "region", "raw_orders", "", "Unknown where missing"),
    ("validated_orders", "total_amount", "raw_orders", "quantity unit_price", "pieces times price after cleaning, in two decimals"),
    ("dim_customer", "customer_id customer_email", "validated_orders", "", "taken over"),
    ("dim_customer", "lifetime_orders", "validated_orders", "order_id", "different values per customer and address"),
    ("dim_customer", "lifetime_spend", "validated_orders", "total_amount", "sum per customer and address"),
    ("dim_product", "product_id product_category", "validated_orders", "", "taken over"),
    ("dim_product", "avg_unit_price", "validated_orders", "unit_price", "mean per product and category"),
    ("dim_product", "times_ordered", "validated_orders", "product_id", "lines per product and category"),
    ("dim_date", "order_date", "validated_orders", "", "taken over"),
    ("dim_date", "order_year", "validated_orders", "order_date", "year of an ISO date"),
    ("dim_date", "order_month", "validated_orders", "order_date", "month of an ISO date"),
    ("dim_date", "order_day", "validated_orders", "order_date", "day of an ISO date"),
    ("dim_date", "order_quarter", "validated_orders", "order_date", "quarter of an ISO date, Q4 for other dates"),
    ("fact_orders", " ".join(FACT_COLUMNS), "validated_orders", "", "taken over"),
    ("vw_monthly_revenue", "order_year order_month", "dim_date", "", "group"),
    ("vw_monthly_revenue", "total_revenue", "fact_orders", "total_amount", "sum per month"),
    ("vw_monthly_revenue", "total_orders", "fact_orders", "order_id", "different values per month"),
    ("vw_category_performance", "product_category", "dim_product", "", "group"),
    ("vw_category_performance", "orders", "fact_orders", "order_id", "lines per category"),
    ("vw_category_performance", "units_sold", "fact_orders", "quantity", "sum per category"),
    ("vw_category_performance", "revenue", "fact_orders", "total_amount", "sum per category"),
    ("vw_region_performance", "region", "fact_orders", "", "group"),
    ("vw_region_performance", "orders", "fact_orders", "order_id", "lines per region"),
    ("vw_region_performance", "revenue", "fact_orders", "total_amount", "sum per region"),
    ("vw_top_customers", "customer_id customer_email lifetime_orders lifetime_spend", "dim_customer", "", "taken over"),
    ("vw_anomalies_amount_mismatch", " ".join(FACT_COLUMNS), "fact_orders", "", "taken over"),
    ("vw_anomalies_high_value_orders", " ".join(FACT_COLUMNS), "fact_orders", "", "taken over"),
)


def _steps(select: str) -> str:
    """A select over ``steps``, each column with its sources, and ``held``."""
    rows = [
        f"('{table}', '{c}', '{origin}', '{s}', '{how}')"
        for table, columns, origin, sources, how in STEPS
        for c in columns.split()
        for s in (sources or c).split()
    ]
    steps = f'SELECT * FROM (VALUES {", ".join(rows)}) t("table", "column", source_table, source_column, transformation)'
    return _catalog(f"SELECT * FROM (WITH steps AS ({steps}) {select})")


def _objects() -> str:
    names = ["validated_orders", "dim_customer", "dim_product", "dim_date", "fact_orders"]
    names += [f"vw_{r}" for r in REPORTS]
    return _union(
        [f"SELECT '{n}' AS name, 'temporary view' AS type, {len(TABLE_COLUMNS[n])} AS columns, count(*) AS rows FROM {n}" for n in names]
    )


WHOLE = (
    "order_id", "customer_id", "product_id", "quantity", "lifetime_orders", "times_ordered", "order_year",
    "order_month", "order_day", "total_orders", "orders", "units_sold",
)
FLOAT = ("unit_price", "total_amount", "lifetime_spend", "avg_unit_price", "total_revenue", "revenue")


def _catalog_rows() -> str:
    """The catalog of all columns, by the stage that makes their table."""
    made = {"raw_orders": "01_ingest", "validated_orders": "02_validate"}
    to = {
        "01_ingest": "staging/staging_orders", "02_validate": "staging/validated_orders",
        "03_transform": "warehouse", "04_generate_reports": "reports",
    }
    rows = []
    for table, columns in TABLE_COLUMNS.items():
        stage = made.get(table, "04_generate_reports" if table.startswith("vw_") else "03_transform")
        for c in columns:
            kind = "int" if c in WHOLE else "float" if c in FLOAT else "string"
            pii = "yes" if c == "customer_email" else "no"
            rows.append(f"('{table}', '{c}', '{kind}', '{pii}', '{stage}', '{to[stage]}')")
    return f'SELECT * FROM (VALUES {", ".join(rows)}) t("table", "column", data_type, pii, source_stage, target)'


def _extra() -> str:
    scores = f"b AS ({_score('raw_orders')}), a AS ({_score('validated_orders')})"
    none = "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)"
    return _with(
        f"{RAW},{VALIDATED}, {scores}",
        f"""SELECT '02_validate' AS stage, b.quality_score AS quality_score_before, a.quality_score AS quality_score_after,
  round(a.quality_score - b.quality_score, 2) AS improvement_points, b.later_duplicates AS duplicates_removed,
  0 AS schema_type_mismatches, CAST(NULL AS INTEGER) AS objects_created, CAST(NULL AS INTEGER) AS files_exported
FROM a, b
UNION ALL SELECT '01_ingest', {none}, NULL, NULL, NULL
UNION ALL SELECT '03_transform', {none}, NULL, {5 + len(REPORTS)}, NULL
UNION ALL SELECT '04_generate_reports', {none}, NULL, NULL, {1 + len(REPORTS)}""",
    )


ORDER_DAY = (
    "CAST(coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%d/%m/%Y')) AS DATE)"
)
ALL = ", ".join(COLUMNS)


def _validity_masks() -> str:
    shares = ", ".join(f"avg(CAST({_valid(r)} AS INTEGER)) AS {r}_valid" for r in RULES)
    return _raw(f"SELECT count(*) AS rows, {shares} FROM raw_orders")


def _flag(rule: str, column: str) -> str:
    return _raw(f"SELECT order_id, product_id, {column}, {_valid(rule)} AS valid FROM raw_orders")


ORACLE: dict[str, str] = {
    "raw_orders": _raw("SELECT * FROM raw_orders"),
    "standardized_columns": _raw("SELECT * FROM raw_orders"),
    "na_token_nulls": _na_tokens(),
    "csv_roundtrip": _raw(
        "SELECT * REPLACE (payment_method || ', \"' || coalesce(region, '') || '\"' AS payment_method) FROM raw_orders"
    ),
    "inferred_types": _with(f"{RAW},{DAMAGED}", _types(COLUMNS)),
    "schema_report": _schema_report(),
    "null_audit": _raw(_null_counts("raw_orders")),
    "duplicate_count": _raw(
        f"""SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS later_duplicates,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_duplicate_sets
FROM (SELECT count(*) AS n FROM raw_orders GROUP BY {ALL})"""
    ),
    "duplicate_rows": _raw(
        f"SELECT {ALL}, count(*) AS copies FROM raw_orders GROUP BY {ALL} HAVING count(*) > 1"
    ),
    "email_validity": _flag("email", "customer_email"),
    "category_validity": _flag("category", "product_category"),
    "quantity_validity": _flag("quantity", "quantity"),
    "price_validity": _flag("price", "unit_price"),
    "duplicate_members": _raw(
        f"""SELECT {ALL}, member, copies FROM (
  SELECT *, row_number() OVER (PARTITION BY {ALL}) AS member, count(*) OVER (PARTITION BY {ALL}) AS copies
  FROM raw_orders) WHERE copies > 1"""
    ),
    "row_issue_rows": _raw(
        f"""SELECT {ALL}, member, copies > 1 OR {" OR ".join(f"{c} IS NULL" for c in COLUMNS)}
  OR {" OR ".join(f"NOT ({_valid(r)})" for r in RULES)} AS has_issue FROM (
  SELECT *, row_number() OVER (PARTITION BY {ALL}) AS member, count(*) OVER (PARTITION BY {ALL}) AS copies
  FROM raw_orders)"""
    ),
    "recompute_total_amount_fine": _raw(
        f"SELECT * REPLACE ({AMOUNT} AS total_amount) FROM (SELECT * REPLACE "
        "(unit_price + (order_id % 997) / 100000000.0e0 AS unit_price) FROM raw_orders)"
    ),
    "validity_masks": _validity_masks(),
    "row_issue_flag": _raw(
        f"""SELECT CAST(n AS BIGINT) AS rows, CAST(issues AS BIGINT) AS issue_rows,
  round(issues / n * 100, 2) AS issue_pct FROM ({_counts("raw_orders")})"""
    ),
    "quality_score_before": _raw(_score("raw_orders")),
    "product_median_price": _with(
        f"{RAW},{MEDIANS}", "SELECT product_id, median FROM medians WHERE median IS NOT NULL"
    ),
    "global_median_price": _with(f"{RAW},{MEDIANS}", "SELECT median(unit_price) AS median FROM group_filled"),
    "impute_unit_price": _with(f"{RAW},{MEDIANS}", "SELECT * FROM imputed"),
    "fill_unknown": _raw(
        "SELECT * REPLACE (coalesce(product_category, 'Unknown') AS product_category, "
        "coalesce(region, 'Unknown') AS region) FROM raw_orders"
    ),
    "drop_null_email": _raw("SELECT * FROM raw_orders WHERE customer_email IS NOT NULL"),
    "deduplicate": _raw("SELECT DISTINCT * FROM raw_orders"),
    "filter_positive": _raw("SELECT * FROM raw_orders WHERE quantity > 0 AND unit_price > 0"),
    "title_case_category": _raw(
        f"SELECT * REPLACE ({TITLE.format('trim(product_category)')} AS product_category) FROM raw_orders"
    ),
    "invalid_email_to_null": _raw(
        "SELECT * REPLACE (nullif(customer_email, 'not-an-email') AS customer_email) FROM raw_orders"
    ),
    "recompute_total_amount": _raw(f"SELECT * REPLACE ({AMOUNT} AS total_amount) FROM raw_orders"),
    "validated_orders": _validated("SELECT * FROM validated_orders"),
    "validated_orders_text_ids": _validated(
        "SELECT * REPLACE ('C' || order_id AS order_id, 'K' || customer_id AS customer_id, "
        "product_id || 'A' AS product_id) FROM validated_orders"
    ),
    "quality_score_after": _validated(_score("validated_orders")),
    "quality_score_summary": _summary(),
    "data_quality_report": _validated(
        f"""SELECT b."column", b.nulls AS nulls_before_cleaning, a.nulls AS nulls_after_cleaning
FROM ({_null_counts("raw_orders")}) b JOIN ({_null_counts("validated_orders")}) a ON a."column" = b."column\""""
    ),
    "dim_customer": _star("SELECT * FROM dim_customer"),
    "dim_product": _star("SELECT * FROM dim_product"),
    "dim_date": _star("SELECT * FROM dim_date"),
    "fact_orders": _star("SELECT * FROM fact_orders"),
    **{r: _star(f"SELECT * FROM vw_{r}") for r in REPORTS},
    "anomalies_high_value_orders_k2": _star(
        f"""SELECT * FROM fact_orders WHERE total_amount > (
SELECT {MONEY_SUM.format("total_amount")} / count(total_amount) * 2.0e0 FROM fact_orders)"""
    ),
    "report_row_counts": _star(_report_counts()),
    "warehouse_objects": _star(_objects()),
    "lineage_log": _on_lineage("SELECT * EXCLUDE (columns) FROM stages"),
    "lineage_columns": _on_lineage(
        'SELECT stage, target, unnest(from_json(columns, \'["VARCHAR"]\')) AS "column" FROM stages'
    ),
    "lineage_edges": _on_lineage(
        """SELECT source, target, count(*) AS runs, CAST(sum(rows_dropped) AS BIGINT) AS rows_dropped
FROM stages GROUP BY source, target"""
    ),
    "lineage_upstream": "WITH RECURSIVE "
    + f"{RAW},{STAR},\n{_lineage()}".strip()
    + """,
found AS (
  SELECT source AS ancestor, 1 AS distance FROM stages WHERE target = 'reports'
  UNION
  SELECT s.source, f.distance + 1 FROM found f JOIN stages s ON s.target = f.ancestor
)
SELECT ancestor, min(distance) AS distance FROM found GROUP BY ancestor""",
    "lineage_extra": _extra(),
    "catalog_from_csv": _catalog_rows(),
    "lineage_log_flat": _on_lineage("SELECT * FROM stages"),
    "generated_orders": _generated(),
    "sample_rows": _sample(
        f"""SELECT {ALL} FROM drawn
ORDER BY draw, {", ".join(f"{c} NULLS FIRST" for c in COLUMNS)} LIMIT 150"""
    ),
    "sample_fraction": _sample(f"SELECT {ALL} FROM drawn WHERE draw < {round(0.04 * 2147483647)}"),
    "data_dictionary": _catalog("SELECT * FROM documented"),
    "pii_columns": _catalog("SELECT * FROM documented WHERE pii <> 'no'"),
    "dictionary_coverage": _catalog('SELECT held.* FROM held ANTI JOIN documented USING ("table", "column")'),
    "csv_mixed_files": _raw(
        "SELECT * REPLACE (CASE WHEN order_id % 50 = 3 THEN payment_method || chr(10) || '\"' || order_date || '\"' "
        "ELSE payment_method END AS payment_method) FROM raw_orders"
    ),
    "column_states": _raw(
        f"""SELECT t AS "table", c AS "column",
  CASE WHEN t = 'complete' THEN 'present' WHEN c IN ('region', 'total_amount') THEN 'missing' ELSE 'present' END AS state,
  count(*) FILTER (t = 'complete' OR quantity > 0) AS rows
FROM raw_orders, unnest(['complete', 'partial']) AS x(t), unnest([{", ".join(f"'{c}'" for c in COLUMNS)}]) AS y(c) GROUP BY t, c
UNION ALL SELECT 'partial', 'note', 'unexpected', count(*) FROM raw_orders WHERE quantity > 0"""
    ),
    "validated_orders_lone_prices": _with(f"{LONE},{VALIDATED}", "SELECT * FROM validated_orders"),
    "quality_score_lone_prices": _with(LONE, _score("raw_orders")),
    "column_lineage": _steps(
        """SELECT s.*, a.nulls AS source_nulls, b.nulls FROM steps s
JOIN held a ON a."table" = s.source_table AND a."column" = s.source_column
JOIN held b ON b."table" = s."table" AND b."column" = s."column\""""
    ),
    "column_upstream": _steps(
        """SELECT ancestor, CAST(min(distance) AS INTEGER) AS distance, any_value(rows) AS rows, any_value(nulls) AS nulls FROM (
  WITH RECURSIVE up(ancestor, distance) AS (
    SELECT source_table || '.' || source_column, 1 FROM steps WHERE "table" = 'vw_category_performance' AND "column" = 'revenue'
    UNION SELECT source_table || '.' || source_column, distance + 1 FROM up JOIN steps ON "table" || '.' || "column" = ancestor)
  SELECT * FROM up) JOIN held ON held."table" || '.' || held."column" = ancestor GROUP BY ancestor"""
    ),
    "column_transformations": _steps(
        """SELECT held."table", held."column", coalesce(any_value(transformation), 'as it came in') AS transformation, rows, nulls
FROM held LEFT JOIN steps USING ("table", "column") GROUP BY ALL"""
    ),
    "table_versions": _star(
        "SELECT 'staging/staging_orders' AS \"table\", CAST(1 AS BIGINT) AS versions, count(*) AS rows FROM raw_orders UNION ALL "
        "SELECT 'staging/validated_orders', 1, count(*) FROM validated_orders UNION ALL "
        + " UNION ALL ".join(f"SELECT 'warehouse/{t}', 1, count(*) FROM {t}" for t in ("dim_customer", "dim_product", "dim_date", "fact_orders"))
    ),
    "lineage_attempts": _on_lineage(
        "SELECT stage, CAST(2 AS BIGINT) AS attempt, rows_in + 1 AS rows_in, rows_out, rows_in + 1 - rows_out AS rows_dropped FROM stages"
    ),
    "run_violations": _on_lineage(
        """SELECT 'run 2' AS run, stage, 'run id is not 8 hexadecimal digits' AS violation FROM stages
UNION ALL SELECT 'run 2', stage, 'rows read are not those written' FROM stages WHERE stage IN ('02_validate', '03_transform')
UNION ALL SELECT '0000000f', stage, unnest(['time goes back', 'source is not the last target']) FROM stages WHERE stage <> '01_ingest'"""
    ),
    "order_date_normalized": _validated(
        f"SELECT *, {ORDER_DAY} AS order_day FROM validated_orders"
    ),
    "monthly_revenue_normalized": _star(
        f"""SELECT CAST(year(d) AS INTEGER) AS order_year, CAST(month(d) AS INTEGER) AS order_month,
  {MONEY_SUM.format("total_amount")} AS total_revenue, count(DISTINCT order_id) AS total_orders
FROM (SELECT *, {ORDER_DAY} AS d FROM fact_orders WHERE order_date IS NOT NULL) GROUP BY 1, 2"""
    ),
    "category_performance_exact": _validated(
        f"""SELECT product_category, count(order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units_sold,
  {MONEY_SUM.format("total_amount")} AS revenue FROM validated_orders GROUP BY product_category"""
    ),
    "dimension_key_check": _star(
        """SELECT 'dim_customer' AS dimension, customer_id AS key, count(*) AS dim_rows
FROM dim_customer GROUP BY customer_id HAVING count(*) > 1
UNION ALL
SELECT 'dim_product', product_id, count(*) FROM dim_product GROUP BY product_id HAVING count(*) > 1"""
    ),
}
