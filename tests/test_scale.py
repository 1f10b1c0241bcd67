"""Plan shapes and results under skew: hot copies, a hot product, a hot amount."""

import statistics

from pyspark.sql import functions as F

from orderflow import registry
from orderflow.operators import clean, median, profile, repeats, sampling, validation
from orderflow.operators.rules import order_rules
from orderflow.plans import fixture, reports, warehouse
from orderflow.sources import versions
from orderflow.sources.csv_files import write_csv
from orderflow.sources.shared_folder import new_folder, stage
from tests.conftest import SF_DIR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, orders):
    """A third copies of one line, a third lines of one product, the rest spread out."""
    line = orders({})
    copies = line.crossJoin(spark.range(3000)).drop("id")
    hot_product = line.crossJoin(spark.range(3000)).withColumns(
        {"order_id": F.col("id") + 10, "unit_price": F.col("id") / F.lit(8.0) + 1}
    ).drop("id")
    spread = line.crossJoin(spark.range(3000)).withColumns(
        {"order_id": F.col("id") + 9000, "product_id": F.col("id") % 50 + 100}
    ).drop("id")
    missing = spread.limit(1).withColumns({"product_id": F.lit(5).cast("bigint"), "unit_price": F.lit(None).cast("double")})
    return copies.unionByName(hot_product).unionByName(spread).unionByName(missing)


def test_counts_and_medians_under_skew(spark, orders):
    df = skewed(spark, orders)
    row = profile.row_profile(df, order_rules()).first()
    assert row.rows == 9001 and row.later_duplicates == 2999
    prices = [3.5] * 3000 + [i / 8.0 + 1 for i in range(3000)]
    filled = clean.impute_unit_price(df).where("product_id = 5 and order_id = 9000").first()
    assert filled.unit_price == statistics.median(prices)
    path = new_folder(spark, "skew")
    observed = validation.profile_and_clean(df, order_rules(), path).first().asDict()
    assert observed == row.asDict()
    assert versions.current(spark, path).count() == 6002


def test_medians_of_many_prices_in_a_narrow_range(spark):
    counts = spark.range(1_000_001).select(
        F.lit(1).alias("product_id"), (1 + F.col("id") / F.lit(1e9)).alias("unit_price"), F.lit(1).cast("bigint").alias("n")
    )
    found = median.median_of_counts(counts, ["product_id"], "unit_price", "n").collect()
    assert [r["median"] for r in found] == [1 + 500_000 / 1e9]


def test_scoring_and_cleaning_share_one_shuffle_of_rows(spark, raw):
    fills = clean.price_fills(clean.price_counts(raw))
    text = plan(validation._marked_rows(raw.where("product_id IS NOT NULL"), fills, "_of_"))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text  # copies collapse before the shuffle


def test_only_rows_without_a_price_meet_the_fills(spark, raw):
    split = plan(clean.impute_unit_price(raw, clean.price_fills(clean.price_counts(raw))))
    assert "IsNull(unit_price)" in split and "Union" in split


def test_lines_are_summed_before_the_category_join(spark, raw):
    fact, products = warehouse.fact_orders(raw), warehouse.dim_product(raw)
    text = plan(reports.category_performance(fact, products))
    join = text.index("Join")
    assert "HashAggregate(keys=[product_id" in text[join:]


def test_a_common_amount_sorts_over_several_columns(spark, raw):
    text = plan(reports.anomalies_high_value_orders(warehouse.fact_orders(raw)))
    assert "rangepartitioning(total_amount" in text and "order_id" in text.split("rangepartitioning")[1][:80]


def test_a_sample_may_cut_through_hot_copies(spark, orders):
    df = skewed(spark, orders)
    keys = ("order_id", "product_id", "quantity", "customer_id")
    out = sampling.sample_rows(df, keys, 5000)
    assert out.count() == 5000 and out.exceptAll(df).isEmpty()


def whole_row_shuffles(df):
    """Exchanges of the plan that group by every column of a table, by their key."""
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line and "payment_method" in line]


def test_rows_without_an_equal_are_not_shuffled(spark, orders):
    df = skewed(spark, orders)
    alone, others = repeats.split(df)
    assert others.distinct().count() < 100 and others.count() >= 3000
    assert not others.exceptAll(df).count() and alone.count() + others.count() == 9001
    assert not whole_row_shuffles(alone)


def test_a_crowded_filter_loses_no_copy(spark, orders, monkeypatch):
    df = skewed(spark, orders)
    monkeypatch.setattr(repeats, "FILTER_BITS", 64)
    alone, others = repeats.split(df)
    assert others.count() > 3020 and alone.count() + others.count() == 9001
    assert {r["copies"] for r in profile.duplicate_sets(df).collect()} == {3000}
    assert clean.deduplicate(df).count() == df.distinct().count()


def test_a_filter_of_many_hashes_lets_few_others_pass(spark):
    wanted = spark.range(2_000_000)
    others = spark.range(2_000_000, 3_000_000)
    assert repeats.among(wanted, wanted, "id").count() == 2_000_000
    assert repeats.among(others, wanted, "id").count() < 10_000


def test_equal_cells_that_differ_in_bits_have_one_hash(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), "x"), (float("nan"), "x")], "a double, b string")
    assert sorted(r["copies"] for r in profile.duplicate_sets(df).collect()) == [2, 2]


def test_only_prices_of_products_that_lack_one_are_counted(spark, orders):
    df = skewed(spark, orders)
    counts = clean.price_counts(df)
    missing = counts.where("unit_price is null").select("product_id")
    assert {r.product_id for r in repeats.among(counts, missing, "product_id").select("product_id").distinct().collect()} == {5}
    assert [(r.product_id, r.missing) for r in clean.product_fills(counts).collect()] == [(5, 1)]


def test_small_groups_are_ranked_and_large_ones_cut(spark, monkeypatch):
    rows = [(g, float(v), n) for g, size in ((1, 3), (2, 40), (3, 41)) for v in range(size) for n in (1, 2)]
    counts = spark.createDataFrame(rows, "g int, v double, n bigint")
    monkeypatch.setattr(median, "_RANKED", 50)
    small, large = median._by_size(counts, ["g"])
    assert {r.g for r in small.collect()} == {1} and {r.g for r in large.collect()} == {2, 3}
    found = {r.g: r["median"] for r in median.median_of_counts(counts, ["g"], "v", "n").collect()}
    assert found == {1: 1.0, 2: 19.5, 3: 20.0}


def test_months_are_told_apart_without_their_amounts(spark, raw):
    text = plan(reports.monthly_revenue_normalized(warehouse.fact_orders(raw)))
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "order_id" in line]
    assert len(shuffled) == 1
    keys = text[text.index("HashAggregate(keys=[order_year") :]
    assert "functions=[]" in keys  # the distinct ids travel alone


def test_tables_are_written_compactly(spark, orders):
    df = stage(orders({}), "small")
    assert all(".zstd." in name for name in df.inputFiles())


def test_no_task_reads_a_whole_table_for_the_broken_files(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(registry, "write_csv", lambda df, path: (written.update({path.rpartition("/")[2]: plan(df)}), write_csv(df, path)))
    registry.csv_mixed_files(spark, SF_DIR)
    assert "Coalesce" not in written["broken"]


def test_lines_meet_their_parts_before_they_are_wide(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(fixture.raw_orders(spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert text.index("hashpartitioning(l_orderkey") < text.index("hashpartitioning(l_partkey")
