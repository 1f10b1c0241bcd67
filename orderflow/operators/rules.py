"""Validity rules: named boolean columns that are never null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.fixed_values import VALID_CATEGORIES
from orderflow.functions.money import is_positive
from orderflow.functions.text import is_email, is_one_of_ignoring_case


def order_rules(valid_categories: Iterable[str] = VALID_CATEGORIES) -> dict[str, Column]:
    """The four rules of an order line. Add entries to score further rules."""
    return {
        "email": is_email(F.col("customer_email")),
        "quantity": is_positive(F.col("quantity")),
        "price": is_positive(F.col("unit_price")),
        "category": is_one_of_ignoring_case(F.col("product_category"), valid_categories),
    }
