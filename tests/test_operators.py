import random
import statistics

import pytest
from pyspark.sql import functions as F

from orderflow.operators import clean, generate, median, profile, sampling, schema, validation
from orderflow.operators.rules import order_rules
from orderflow.sources import versions
from orderflow.sources.shared_folder import new_folder


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


# --- schema ---------------------------------------------------------------------------


def test_standardize_columns(spark):
    df = spark.createDataFrame([(1, "x")], " InvoiceNo string, `Customer Email ` string".replace(" InvoiceNo", "InvoiceNo"))
    out = schema.standardize_columns(df, {"InvoiceNo": "Order ID", "absent": "z"})
    assert out.columns == ["order_id", "customer_email"]


def test_missing_column_stops_the_run(orders):
    with pytest.raises(ValueError, match="region"):
        schema.require_columns(orders({}).drop("region"))


def test_inferred_types(spark):
    rows = [
        ("1", "1.5", "x", "1", None, "True", "7", "18446744073709551615", "True", "1d"),
        ("2", "3", "4", None, None, "False", "99999999999999999999", "7", None, "2f"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in "abcdefghij"))
    out = {r.column: r.inferred_type for r in schema.inferred_types(df).collect()}
    assert out == {
        "a": "int64", "b": "float64", "c": "object", "d": "float64", "e": "float64",
        "f": "bool", "g": "object", "h": "uint64", "i": "object", "j": "object",
    }


def test_typed_column_with_null_is_a_mismatch(orders):
    report = schema.schema_report(orders({"quantity": None}, {}).drop("region")).collect()
    assert {tuple(r) for r in report} == {("quantity", "int64", "float64"), ("region", "object", "missing")}


def test_text_that_is_no_number_stops_the_run(spark, orders):
    text = orders({}, {"quantity": 3}).select([F.col(c).cast("string") for c in schema.ORDER_COLUMNS])
    odd = text.withColumn("quantity", F.when(F.col("quantity") == "3", "3 pcs").otherwise(F.col("quantity")))
    with pytest.raises(schema.UnreadableValues, match="quantity.*1"):
        schema.require_numbers(schema.findings(odd))
    suffixed = text.withColumn("quantity", F.lit("3d")).withColumn("unit_price", F.lit("2.5f"))
    with pytest.raises(schema.UnreadableValues, match="quantity.*unit_price"):
        schema.require_numbers(schema.findings(suffixed))
    schema.require_numbers(schema.findings(text))
    assert schema.with_order_types(suffixed).where("quantity IS NOT NULL OR unit_price IS NOT NULL").isEmpty()


def test_findings_give_the_schema_report(spark, orders):
    df = orders({"quantity": None}, {"quantity": 2}).withColumn("customer_id", F.lit("C1")).drop("region").withColumn("extra", F.lit(1))
    found = schema.findings(df)
    report = {tuple(r) for r in schema.found_types(spark, found).collect()}
    assert report == {tuple(r) for r in schema.schema_report(df).collect()}
    assert report == {("quantity", "int64", "float64"), ("customer_id", "int64", "object"), ("region", "object", "missing")}
    halves = orders({}, {}).withColumn("quantity", F.lit("2.5"))
    assert schema.fractional_columns(schema.findings(halves), [{"column": "quantity", "expected": "int64", "actual": "float64"}]) == ["quantity"]


def test_a_plan_without_a_required_column_stops_in_its_own_job(orders):
    whole = orders({}, {})
    assert schema.with_required_columns(whole) is whole
    broken = schema.with_required_columns(whole.drop("region"))  # nothing has run so far
    with pytest.raises(Exception, match="lack the columns.*region"):
        broken.collect()
    states = {(r.table, r.column): (r.state, r.rows) for r in schema.column_states({"a": whole.drop("region").withColumn("x", F.lit(1))}).collect()}
    assert states["a", "region"] == ("missing", 2) and states["a", "x"] == ("unexpected", 2) and states["a", "quantity"][0] == "present"


def test_text_ids_stay_text(spark, tmp_path):
    head = "order_id,customer_id,customer_email,product_id,product_category,quantity,unit_price,order_date,region,payment_method,total_amount"
    lines = [
        "C536379,1,a@b.c,85123A,Books,2,100.0,2023-01-05,North,COD,200.0",
        "C536380,1,a@b.c,22423,Books,2,100.0,2023-01-05,North,COD,200.0",
        "536381,1,a@b.c,22423B,Books,2,50.0,2023-01-05,North,COD,100.0",
        "C536390,1,a@b.c,85123A,Books,2,,2023-01-05,North,COD,200.0",
    ]
    path = tmp_path / "orders.csv"
    path.write_text("\n".join([head, *lines]) + "\n")
    from orderflow.plans.pipeline import Pipeline

    run = Pipeline(spark, str(tmp_path / "out"))
    run.run(str(path))
    got = {r.order_id: r for r in run.read("staging/validated_orders").collect()}
    assert set(got) == {"C536379", "C536380", "536381", "C536390"}
    assert got["536381"].unit_price == 50.0 and got["C536390"].unit_price == 100.0
    assert got["536381"].product_id == "22423B"


def test_extra_columns_keep_their_values(spark, orders, tmp_path):
    extra = {"rows": "77", "_mark": "a", "_nth": "b", "later_duplicates": "c", "_raw_region": "d", "_of_mark": "e"}
    df = orders({}, {}, {"order_id": 2, "region": None}).withColumns({k: F.lit(v) for k, v in extra.items()})
    from orderflow.operators.rules import order_rules
    from orderflow.operators.validation import profile_and_clean

    profile_and_clean(df, order_rules(), str(tmp_path / "clean"))
    rows = versions.current(spark, str(tmp_path / "clean")).collect()
    assert sorted(r.order_id for r in rows) == [1, 2]
    assert all(r[k] == v for r in rows for k, v in extra.items())


def test_small_fractions_keep_rows(spark):
    from orderflow.operators.sampling import sample_fraction

    kept = sample_fraction(spark.range(20_000_000).withColumnRenamed("id", "k"), ["k"], 1e-6).count()
    assert 1 <= kept <= 100


def test_amounts_are_exact_or_carry_on(spark):
    from orderflow.functions import money

    rows = [(10**9, 4e-11, 0.04), (10**9, 1.25e-9, 1.25), (1000, 0.12345, 123.45), (1_000_000, 0.00012, 120.0), (100_000, 0.00004, 4.0), (3, 0.335, 1.0), (2, 3.5, 7.0), (10**12, 5000.0, 5e15), (1, float("inf"), float("inf"))]
    df = spark.createDataFrame(rows, "q bigint, p double, want double")
    got = df.select("want", money.line_amount(F.col("q"), F.col("p")).alias("got"), money.amount_differs(F.col("q"), F.col("p"), F.col("want")).alias("bad")).collect()
    assert [r.got for r in got] == [0.04, 1.25, 123.45, 120.0, 4.0, 1.0, 7.0, 5e15, float("inf")]
    assert [r.bad for r in got] == [False, False, False, False, False, True, False, False, False]
    total = df.agg(money.rounded_sum(F.col("want")).alias("t"), money.rounded_average(F.col("p")).alias("a")).first()
    assert total.t == float("inf") and total.a == float("inf")
    fine = spark.createDataFrame([(0.12345,), (0.12355,)], "p double").agg(money.rounded_average(F.col("p"))).first()[0]
    assert fine == 0.12


# --- median ---------------------------------------------------------------------------


def test_median_matches_brute_force(spark):
    random.seed(3)
    groups = {
        1: [5.0], 2: [1.0, 2.0], 3: [-1.0, 0.0, 0.0, 4.25, 1e9],
        4: [round(random.uniform(-50, 500), 2) for _ in range(501)],
        5: [7.0] * 400 + [round(random.uniform(1, 9), 2) for _ in range(200)],
        6: [0.001, 0.002, 0.0015, 1e-9],
        7: [1 + i / 1e7 for i in range(3000)],
        8: [1 + i * 2.0**-52 for i in range(300)] + [1.0, 1e300],
        10: [float("inf"), 3.0, float("inf"), -2.0, 8.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [(1, None), (9, None)]
    counts = (
        spark.createDataFrame(rows, "g int, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    out = median.median_of_counts(counts, ["g"], "v", "n").collect()
    assert {r.g: r["median"] for r in out} == {g: statistics.median(v) for g, v in groups.items()}
    every = [v for values in groups.values() for v in values]
    assert median.median_of_counts(counts, [], "v", "n").first()[0] == statistics.median(every)


def test_value_bucket_keeps_order(spark):
    values = [-1e300, -5.0, -1e-300, 0.0, 1e-300, 0.5, 1.0, 1.0001, 7.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[0] for r in df.select("v", median.value_bucket(F.col("v")).alias("b")).orderBy("v").select("b").collect()]
    assert buckets == sorted(buckets)


# --- cleaning -------------------------------------------------------------------------


def prices(df):
    return sorted((r.order_id, r.unit_price) for r in df.collect())


PRICE_ROWS = [
    {"order_id": 1, "product_id": 1, "unit_price": 10.0},
    {"order_id": 2, "product_id": 1, "unit_price": 20.0},
    {"order_id": 3, "product_id": 1, "unit_price": None},
    {"order_id": 4, "product_id": 2, "unit_price": None},
    {"order_id": 5, "product_id": None, "unit_price": 99.0},
    {"order_id": 6, "product_id": None, "unit_price": None},
    {"order_id": 7, "product_id": 3, "unit_price": -1.0},
]


def test_impute_by_product_then_overall(orders):
    df = orders(*PRICE_ROWS)
    out = clean.impute_unit_price(df)
    overall = statistics.median([10.0, 20.0, 15.0, -1.0])
    assert prices(out) == [(1, 10.0), (2, 20.0), (3, 15.0), (4, overall), (5, overall), (6, overall), (7, -1.0)]


def test_impute_without_any_price_leaves_null(orders):
    assert clean.impute_unit_price(orders({"unit_price": None})).first().unit_price is None


def test_clean_keeps_its_step_order(orders):
    out = clean.clean(
        orders(
            {"order_id": 1, "product_category": "books"},
            {"order_id": 1, "product_category": "books"},
            {"order_id": 1, "product_category": " BOOKS "},
            {"order_id": 2, "customer_email": "not-an-email"},
            {"order_id": 3, "customer_email": "broken@nodot"},
            {"order_id": 4, "customer_email": None},
            {"order_id": 5, "quantity": 0},
            {"order_id": 6, "unit_price": -1.0},
            {"order_id": 7, "product_category": None, "region": None, "total_amount": 0.0},
        )
    )
    rows = sorted((r.order_id, r.product_category, r.region, r.total_amount) for r in out.collect())
    # Copies are dropped before re-spelling, so two spellings of one line both stay.
    assert rows == [
        (1, "Books", "North", 7.0), (1, "Books", "North", 7.0), (3, "Books", "North", 7.0),
        (7, "Unknown", "Unknown", 7.0),
    ]


def test_regex_mode_drops_every_malformed_email(orders):
    out = clean.clean(orders({"customer_email": "broken@nodot"}, {"order_id": 2}), email_mode="regex")
    assert [r.order_id for r in out.collect()] == [2]


def test_cleaning_twice_changes_nothing_but_new_copies(raw):
    once = clean.clean(raw).distinct()
    assert as_set(clean.clean(once)) == as_set(once)


# --- profile --------------------------------------------------------------------------


def test_profile_counts(orders):
    df = orders(
        {}, {}, {}, {"order_id": 2, "region": None}, {"order_id": 3, "quantity": -1},
        {"order_id": 4, "product_category": "Unknown"}, {"order_id": 5},
    )
    row = profile.row_profile(df, order_rules()).first().asDict()
    assert row["rows"] == 7 and row["later_duplicates"] == 2 and row["issue_rows"] == 6
    assert row["nulls:region"] == 1 and row["nulls:order_id"] == 0
    assert row["valid:quantity"] == 6 and row["valid:category"] == 6 and row["valid:email"] == 7


def test_extra_columns_and_rules_enter_the_profile(orders):
    df = orders({}, {}).withColumn("note", F.lit(None).cast("string"))
    rules = order_rules() | {"north": F.col("region") == "South"}
    row = profile.row_profile(df, rules).first().asDict()
    assert row["nulls:note"] == 2 and row["valid:north"] == 0 and row["later_duplicates"] == 1


def test_scores_of_an_empty_table_are_null(orders):
    empty = orders({}).where("1 = 0")
    score = profile.quality_score(profile.row_profile(empty, order_rules())).first()
    assert score.rows == 0 and score.quality_score is None and score.validity_pct is None


def test_scores_are_percentages(raw):
    score = profile.quality_score(profile.row_profile(raw, order_rules())).first().asDict()
    assert all(0 <= v <= 100 for k, v in score.items() if k.endswith(("_pct", "_score")))


# --- one pass profile and clean --------------------------------------------------------


def check_one_pass(spark, df):
    path = new_folder(spark, "one_pass")
    observed = validation.profile_and_clean(df, order_rules(), path).first().asDict()
    assert observed == profile.row_profile(df, order_rules()).first().asDict()
    assert as_set(versions.current(spark, path)) == as_set(clean.clean(df))


def test_one_pass_equals_two(spark, raw):
    check_one_pass(spark, raw)


def test_one_pass_with_rows_that_meet_after_filling(spark, orders):
    check_one_pass(
        spark,
        orders(
            {"product_category": None}, {"product_category": "Unknown"}, {"product_category": "Unknown"},
            {"product_category": None}, {"unit_price": None}, {}, {"region": None}, {"region": "Unknown"},
            {"order_id": 2, "customer_email": None}, {"order_id": 2, "customer_email": None},
        ),
    )


def test_one_pass_with_prices_that_fills_overwrite(spark, orders):
    check_one_pass(spark, orders(*PRICE_ROWS))
    lone = [{"product_id": None, "unit_price": p, "region": r} for p in (None, 1.0, 2.0, 2.0) for r in (None, "Unknown", "North")]
    check_one_pass(spark, orders({}, *lone, *lone[:5]))


def test_one_pass_on_an_empty_table(spark, orders):
    check_one_pass(spark, orders({}).where("order_id > 5"))


# --- generator and sampling -------------------------------------------------------------


def test_generated_orders_have_the_expected_defects(spark):
    df = generate.generate_orders(spark, 20000)
    row = profile.row_profile(df, order_rules()).first().asDict()
    base = 20000
    assert abs(row["rows"] - base * 1.03) < 120
    assert abs(row["nulls:customer_email"] / row["rows"] - 0.04) < 0.006
    assert abs(row["nulls:product_category"] / row["rows"] - 0.02) < 0.005
    assert abs(row["nulls:unit_price"] / row["rows"] - 0.01) < 0.004
    assert 0 < row["later_duplicates"] <= row["rows"] - base
    assert df.where("order_date like '%/%'").count() >= base // 7
    assert df.where("quantity < 0").count() > 0 and df.where("unit_price = -1").count() > 0
    days = df.where("order_date like '____-%'").agg(F.min("order_date"), F.max("order_date")).first()
    assert days[0] == "2023-01-01" or days[0] == "2023-01-02"
    assert days[1] <= "2024-12-31"


def test_generation_does_not_depend_on_partitioning(spark):
    one = generate.dirty_orders(spark.range(1, 2001, 1, 1), F.lit(2000))
    many = generate.dirty_orders(spark.range(1, 2001, 1, 7), F.lit(2000))
    assert as_set(one) == as_set(many)


KEYS = ("order_id", "product_id", "quantity", "customer_id")


@pytest.mark.parametrize("n", [0, 1, 150, 3000, 100000])
def test_sample_is_the_rows_with_the_lowest_draws(raw, n):
    drawn = raw.withColumn("place", sampling.draw(sampling._key(KEYS), 101))
    places = sorted(r.place for r in drawn.select("place").collect())[:n]
    top = sampling.sample_rows(raw, KEYS, n)
    found = top.withColumn("place", sampling.draw(sampling._key(KEYS), 101))
    assert sorted(r.place for r in found.select("place").collect()) == places
    assert top.exceptAll(raw).isEmpty()


def test_sample_is_cut_finer_while_a_range_has_many_rows(raw, monkeypatch):
    once = as_set(sampling.sample_rows(raw, KEYS, 150))
    monkeypatch.setattr(sampling, "_FEW_ROWS", 0)
    assert as_set(sampling.sample_rows(raw, KEYS, 150)) == once


def test_sample_counts_copies(orders):
    df = orders(*[{} for _ in range(50)], {"order_id": 2})
    assert sampling.sample_rows(df, KEYS, 20).count() == 20


def test_a_tiny_fraction_still_keeps_rows(spark):
    df = spark.range(30_000_000)
    assert 0 < sampling.sample_fraction(df, ["id"], 1e-6).count() < 200


def test_sample_fraction_is_a_subset(raw):
    part = sampling.sample_fraction(raw, KEYS, 0.1)
    assert 0.05 < part.count() / raw.count() < 0.15
    assert part.exceptAll(raw).isEmpty()
