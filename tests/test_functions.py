import math
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from orderflow.fixed_values import NA_TOKENS
from orderflow.functions import dates, draws, money, text


def evaluate(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def test_header_name():
    assert text.header_name(" Order ID ") == "order_id"
    assert text.header_name("Customer Email") == "customer_email"
    assert text.header_name("Unit  Price\t(net)") == "unit_price_(net)"


def test_na_tokens(spark):
    values = [*NA_TOKENS, "none", "-", "x", None]
    out = evaluate(spark, values, text.null_if_na)
    assert out == [None] * len(NA_TOKENS) + ["none", "-", "x", None]


def test_title_case_follows_every_non_letter(spark):
    values = ["men's t-shirt", "home & kitchen", "3d print", "ELECTRONICS", "o'neill é école", "", None]
    expected = ["Men'S T-Shirt", "Home & Kitchen", "3D Print", "Electronics", "O'Neill É École", "", None]
    assert evaluate(spark, values, text.title_case) == expected
    assert expected[:-1] == [v.title() for v in values[:-1]]


def test_strip_removes_all_whitespace(spark):
    values = ["\tbooks \n", " a b ", "plain", "\x1cx\x1f", " \t ", "a\n", None]
    assert evaluate(spark, values, text.strip_whitespace) == [
        None if v is None else v.strip() for v in values
    ]


def test_email(spark):
    cases = {
        "a@b.c": True,
        "a@b.c\n": True,
        "a@b.c\r": False,
        "a@@b.c": False,
        "a @b.c": False,
        "a@b..c": True,
        " a@b.c": False,
        "a@b": False,
        "not-an-email": False,
        "x @b.c": False,
        None: False,
    }
    assert evaluate(spark, list(cases), text.is_email) == list(cases.values())


def test_category_is_lowered_but_not_stripped(spark):
    out = evaluate(
        spark, ["BOOKS", " books", "Toys", None], lambda c: text.is_one_of_ignoring_case(c, ("books", "toys"))
    )
    assert out == [True, False, True, False]


def test_positive_is_false_for_null_and_nan(spark):
    values = [1.0, 0.0, -1.0, None, math.nan]
    assert evaluate(spark, values, money.is_positive, "double") == [True, False, False, False, False]


def test_line_amount_rounds_half_to_even(spark):
    pairs = [(1, 1.005), (1, 0.125), (3, 0.335), (7, 19.99), (2, 2087.645), (1, None)]
    df = spark.createDataFrame(pairs, "q bigint, p double")
    out = [r[0] for r in df.select(money.line_amount(F.col("q"), F.col("p"))).collect()]
    cent = Decimal("0.01")
    expected = [
        None if p is None else float((q * Decimal(str(p))).quantize(cent, ROUND_HALF_EVEN))
        for q, p in pairs
    ]
    assert out == expected


def test_dates(spark):
    values = [
        "2023-01-05", "2023-01-05 10:20", "2023-01-05T10:20:30Z", "05/01/2023", "2023-1-5",
        "20230105", "2023-13-01", "2023-02-31", "2023", "", None,
    ]
    iso = [str(d) if d else None for d in evaluate(spark, values, dates.iso_date)]
    assert iso == ["2023-01-05"] * 3 + [None] * 8
    both = [str(d) if d else None for d in evaluate(spark, values, dates.any_date)]
    assert both == ["2023-01-05"] * 4 + [None] * 7


def test_quarter_of_missing_month_is_the_last(spark):
    out = evaluate(spark, [1, 3, 4, 6, 7, 9, 10, 12, None], dates.quarter_label, "int")
    assert out == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4", "Q4"]


def python_draw(key, salt):
    m = draws.MODULUS
    x = (key % m * (48271 + 1000003 * salt) + (key >> 31) * 69621 + 12345 + salt) % m
    return pow(x, 5, m)


def test_draw_matches_big_integer_arithmetic(spark):
    keys = [0, 1, 2, 4999, 2**31 - 2, 2**31, 10**12, 2**53 + 1, 2**62]
    for salt in (1, 18, 121):
        out = evaluate(spark, keys, lambda c, s=salt: draws.draw(c, s), "bigint")
        assert out == [python_draw(k, salt) for k in keys]


@pytest.mark.parametrize("salt", [1, 7, 16])
def test_draws_spread_evenly(spark, salt):
    counts = (
        spark.range(1, 50001).groupBy(draws.draw_below(F.col("id"), salt, 10).alias("d")).count().collect()
    )
    assert len(counts) == 10
    assert all(abs(r["count"] - 5000) < 400 for r in counts)
