"""Every registered query against its SQL counterpart on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from orderflow.oracle import ORACLE
from orderflow.registry import QUERIES
from tests.conftest import SF_DIR

TABLES = "region nation customer supplier part orders lineitem".split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}
SQL = ORACLE


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.items() <= entry_point.queries().items()
    assert SQL.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, engine, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = engine.sql(SQL[name])
    types = {f.name: TYPES[f.dataType.simpleString()] for f in result.schema}
    assert types == dict(zip(expected.columns, map(str, expected.types)))
    assert by_name(result.columns, result.collect()) == by_name(expected.columns, expected.fetchall())


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_stays_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct"):
        assert operator not in text


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["filter_positive"](spark, SF_DIR))
    assert "GreaterThan(quantity,0)" in text and "GreaterThan(unit_price,0.0)" in text
    assert "IsNotNull(customer_email)" in plan(QUERIES["drop_null_email"](spark, SF_DIR))


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["region_performance"](spark, SF_DIR))
    assert "ReadSchema: struct<order_id:bigint,region:string,total_amount:double>" in text


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_customers"](spark, SF_DIR))


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["order_year", "order_month", "total_revenue", "total_orders"]
    assert result.count() == 81
