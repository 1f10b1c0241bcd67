"""Money arithmetic that is exact wherever the values allow it, and never stops a run.

Amounts are DOUBLE at the edges. Inside, prices of up to 4 decimals are whole units of 1/10,000, which
add up exactly in any order of partitions without the text round trip of a cast per row; finer
prices are DECIMAL(28,10) where that cut does not change the amount. Values beyond these, infinities and NaN go on in DOUBLE arithmetic.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below these bounds products and sums of units stay within BIGINT and DECIMAL(38).
_UNIT_PRICE = 1e8
_UNIT_QUANTITY = 1e5
_EXACT_AMOUNT = 1e14

# An amount may change by less than this when its price is cut to 10 decimals: float noise only.
_CUT = 1e-6


def _price_units(value: Column) -> Column:
    return F.rint(value * 10000).try_cast("bigint")


def _in_units(quantity: Column, price: Column) -> Column:
    """Whether the product is exact in whole units of the price."""
    return (
        (F.abs(quantity) < _UNIT_QUANTITY) & (F.abs(price) < _UNIT_PRICE) & (F.rint(price * 10000) / 10000 == price)
    )


def _exact_product(quantity: Column, price: Column) -> Column:
    """DECIMAL product of a price cut to 10 decimals; null where the cut would count, and out of range."""
    units = price.try_cast("decimal(28,10)")
    lost = F.abs((units.cast("double") - price) * quantity)
    return quantity.try_cast("decimal(10,0)") * F.when(lost < _CUT, units)


def _float_product(quantity: Column, price: Column) -> Column:
    return quantity.cast("double") * price


def line_amount(quantity: Column, unit_price: Column) -> Column:
    """quantity x price at two decimals, halves to even."""
    units = F.bround(quantity * _price_units(unit_price), -2) / F.lit(10000.0)
    exact = F.bround(_exact_product(quantity, unit_price), 2).cast("double")
    return F.when(_in_units(quantity, unit_price), units).otherwise(
        F.coalesce(exact, F.bround(_float_product(quantity, unit_price), 2))
    )


def amount_differs(quantity: Column, unit_price: Column, amount: Column) -> Column:
    """quantity x price and the amount differ once both are rounded half up."""
    units = F.round(quantity * _price_units(unit_price), -2) != F.round(_price_units(amount), -2)
    exact = F.round(_exact_product(quantity, unit_price), 2) != F.round(amount.try_cast("decimal(28,10)"), 2)
    plain = F.round(_float_product(quantity, unit_price), 2) != F.round(amount, 2)
    in_units = _in_units(quantity, unit_price) & _in_units(F.lit(1), amount)
    return F.when(in_units, units).otherwise(F.coalesce(exact, plain))


def _exact(amount: Column) -> Column:
    return F.max(F.abs(amount)) < _EXACT_AMOUNT


def sum_cents(amount: Column) -> Column:
    """Sum of two-decimal amounts in cents; of amounts that are no such, in DOUBLE arithmetic."""
    cents = F.sum(F.rint(amount * 100).try_cast("bigint").try_cast("decimal(18,0)"))
    return F.when(_exact(amount), cents.cast("double")).otherwise(F.rint(F.sum(amount) * 100))


def from_cents(cents: Column) -> Column:
    """Amount of a whole number of cents, below 2^53 exactly."""
    return F.when(F.abs(cents) < 9e15, (F.rint(cents).try_cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("double")).otherwise(cents / 100)


def rounded_sum(amount: Column) -> Column:
    cents = F.sum(F.rint(amount * 100).try_cast("bigint").try_cast("decimal(18,0)"))
    exact = (cents * F.lit(Decimal("0.01"))).cast("double")
    return F.when(_exact(amount), exact).otherwise(F.round(F.sum(amount), 2))


def rounded_average(value: Column) -> Column:
    """Average at two decimals, halves up, from an exact sum of values of up to 10 decimals."""
    total = F.sum(value.try_cast("decimal(24,10)")).try_cast("decimal(38,10)")
    exact = F.round(F.try_divide(total, F.count(value)), 2).cast("double")
    return F.when(_exact(value), exact).otherwise(F.round(F.avg(value), 2))


def is_positive(value: Column) -> Column:
    """value > 0; false for null and NaN (Spark alone would call NaN > 0 true)."""
    return F.coalesce((value > 0) & ~F.isnan(value), F.lit(False))
