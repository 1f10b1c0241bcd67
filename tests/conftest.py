import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    from orderflow import registry

    return registry.raw(spark, SF_DIR)


ORDER = "order_id bigint, customer_id bigint, customer_email string, product_id bigint, " \
    "product_category string, quantity bigint, unit_price double, order_date string, " \
    "region string, payment_method string, total_amount double"


@pytest.fixture
def orders(spark):
    """A maker of small order tables: rows given as changes to a flawless line."""

    def make(*changes):
        base = {
            "order_id": 1,
            "customer_id": 10,
            "customer_email": "a@b.c",
            "product_id": 5,
            "product_category": "Books",
            "quantity": 2,
            "unit_price": 3.5,
            "order_date": "2023-01-05",
            "region": "North",
            "payment_method": "COD",
            "total_amount": 7.0,
        }
        return spark.createDataFrame([tuple((base | c).values()) for c in changes], ORDER)

    return make
