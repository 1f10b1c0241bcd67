import pytest
from pyspark.sql import functions as F

from orderflow.plans import governance, reports, warehouse
from orderflow.plans.fixture import FIXTURE_CATEGORIES
from orderflow.plans.pipeline import Pipeline
from orderflow.sources.csv_files import read_csv, write_csv
from orderflow.sources.shared_folder import new_folder


@pytest.fixture(scope="module")
def finished(spark, raw):
    pipeline = Pipeline(spark, new_folder(spark, "run"), valid_categories=FIXTURE_CATEGORIES)
    rows = pipeline.run(raw)
    return pipeline, rows


def test_stages_are_logged_in_a_chain(finished):
    pipeline, rows = finished
    log = {r.stage: r for r in pipeline.lineage().collect()}
    assert sorted(log) == ["01_ingest", "02_validate", "03_transform", "04_generate_reports"]
    assert {r.run_id for r in log.values()} == {pipeline.run_id}
    assert all(r.rows_dropped == r.rows_in - r.rows_out for r in log.values())
    assert log["01_ingest"].rows_out == log["02_validate"].rows_in == 6169
    assert log["02_validate"].rows_out == log["03_transform"].rows_in == 5673
    assert log["03_transform"].rows_out == 5673
    assert log["04_generate_reports"].rows_in == sum(rows.values())


def test_published_views_can_be_queried(spark, finished):
    pipeline, rows = finished
    for name, n in rows.items():
        assert spark.sql(f"SELECT * FROM vw_{name}").count() == n
        assert read_csv(spark, pipeline.path(f"reports/{name}"), False).count() == n if n else True
    names = {r.name for r in warehouse.warehouse_objects(spark).collect()}
    assert names >= set(warehouse.object_names())


def test_score_summary_values(spark, finished):
    pipeline, _ = finished
    summary = read_csv(spark, pipeline.path("reports/quality_score_summary"))
    values = {r.metric: float(r.value) for r in summary.collect()}
    assert values["quality_score_before"] == 97.83 and values["quality_score_after"] == 99.72
    assert values["rows_dropped_total"] == 6169 - 5673
    assert values["pct_rows_with_any_issue_before"] == 17.73
    assert values["pct_rows_with_any_issue_after"] == 0.0
    assert values["pct_rows_with_any_issue_after_actual"] == 3.40
    assert values["duplicate_rows_removed"] == 169


def test_flat_log_holds_every_stage(spark, finished):
    flat = read_csv(spark, finished[0].path("reports/lineage_log_flat"))
    assert flat.count() == 4


def test_the_catalog_is_published(finished):
    assert finished[0].dictionary().count() == 77


def test_a_second_run_replaces_tables_and_keeps_history(spark, raw, finished):
    pipeline, rows = finished
    again = Pipeline(spark, pipeline.folder, valid_categories=FIXTURE_CATEGORIES)
    assert again.run(raw) == rows
    assert pipeline.lineage().count() == 8
    assert pipeline.tables()["fact_orders"].count() == 5673


def test_a_run_that_fails_leaves_the_old_tables(spark, orders):
    pipeline = Pipeline(spark, new_folder(spark, "run"))
    pipeline.run(orders({}, {"order_id": 2}))
    lost = orders({}).withColumn("region", F.raise_error(F.lit("disk gone")))
    with pytest.raises(Exception, match="disk gone"):
        Pipeline(spark, pipeline.folder).run(lost)
    assert pipeline.read("staging/staging_orders").count() == 2
    with pytest.raises(ValueError, match="no numbers"):
        Pipeline(spark, pipeline.folder).run(orders({}).withColumn("quantity", F.lit("3d")))
    assert pipeline.read("staging/validated_orders").count() == 2 and pipeline.tables()["fact_orders"].count() == 2
    warehouse.drop_warehouse(spark, pipeline.path("warehouse"))
    warehouse.drop_warehouse(spark, pipeline.path("warehouse"))
    with pytest.raises(LookupError):
        pipeline.tables()


def test_objects_have_the_types_of_the_session_catalog(spark, orders):
    orders({}).createOrReplaceTempView("some_foreign_view")
    found = {r.name: r for r in warehouse.warehouse_objects(spark).collect()}
    assert (found["some_foreign_view"].type, found["some_foreign_view"].columns) == ("temporary view", 11)
    spark.catalog.dropTempView("some_foreign_view")


def test_csv_in_with_messy_headers(spark, orders):
    folder = new_folder(spark, "run")
    messy = orders({}, {"order_id": 2, "quantity": None}, {"order_id": 3}).withColumnsRenamed(
        {"order_id": "InvoiceNo", "customer_email": "Customer Email"}
    )
    write_csv(messy, f"{folder}/in")
    pipeline = Pipeline(spark, folder, column_map={"InvoiceNo": "order_id"})
    pipeline.run(f"{folder}/in")
    log = {r.stage: r for r in pipeline.lineage().collect()}
    assert log["01_ingest"].source == f"{folder}/in"
    assert log["02_validate"].rows_out == 2
    assert '"column": "quantity"' in log["02_validate"].extra and "float64" in log["02_validate"].extra


def test_whole_numbers_written_with_a_point_are_kept(spark, orders):
    folder = new_folder(spark, "run")
    ids = orders({}, {"order_id": 2, "customer_id": None}).withColumn("customer_id", F.col("customer_id").cast("double"))
    write_csv(ids.withColumn("quantity", F.lit("2.5")), f"{folder}/in")
    pipeline = Pipeline(spark, folder)
    pipeline.run(f"{folder}/in")
    rows = sorted((r.order_id, r.customer_id, r.quantity, r.total_amount) for r in pipeline.read("staging/validated_orders").orderBy("order_id").collect())
    assert rows == [(1, 10, 2.5, 8.75), (2, None, 2.5, 8.75)]


def test_without_a_source_orders_are_generated_once(spark):
    pipeline = Pipeline(spark, new_folder(spark, "run"))
    pipeline.run()
    first = pipeline.read("staging/staging_orders")
    assert 5100 < first.count() < 5200
    pipeline.generate(10)
    assert read_csv(spark, pipeline.path("raw/raw_orders")).count() == first.count()


def test_a_missing_column_ends_the_run(spark, orders):
    pipeline = Pipeline(spark, new_folder(spark, "run"))
    with pytest.raises(ValueError, match="total_amount"):
        pipeline.run(orders({}).drop("total_amount"))
    assert [r.stage for r in pipeline.lineage().collect()] == ["01_ingest"]


def test_an_empty_source_runs_through(spark, orders):
    pipeline = Pipeline(spark, new_folder(spark, "run"))
    rows = pipeline.run(orders({}).where("order_id > 9"))
    assert set(rows.values()) == {0}


def test_top_customers_breaks_ties(spark):
    spend = [(i, f"c{i}@x.y", 1, 50.0) for i in range(12, 0, -1)] + [(99, "b@x.y", 1, 70.0), (99, "a@x.y", 1, 70.0)]
    df = spark.createDataFrame(spend, "customer_id bigint, customer_email string, lifetime_orders bigint, lifetime_spend double")
    out = [(r.customer_id, r.customer_email) for r in reports.top_customers(df).collect()]
    assert out == [(99, "a@x.y"), (99, "b@x.y")] + [(i, f"c{i}@x.y") for i in range(1, 9)]


def test_a_null_date_leaves_only_the_monthly_report(spark, orders):
    df = orders({}, {"order_id": 2, "order_date": None}, {"order_id": 3, "order_date": "05/01/2023"})
    monthly = reports.monthly_revenue(warehouse.fact_orders(df), warehouse.dim_date(df)).collect()
    assert [(r.order_year, r.order_month, r.total_orders) for r in monthly] == [(None, None, 1), (2023, 1, 1)]
    assert reports.region_performance(df).first().orders == 3


def test_category_report_fans_out_per_product_category(spark, orders):
    df = orders({}, {"order_id": 2, "product_category": "Toys"}, {"order_id": 3, "product_id": 6})
    fanned = reports.category_performance(warehouse.fact_orders(df), warehouse.dim_product(df)).collect()
    assert {r.product_category: r.orders for r in fanned} == {"Books": 3, "Toys": 2}
    exact = reports.category_performance_exact(df).collect()
    assert {r.product_category: r.orders for r in exact} == {"Books": 2, "Toys": 1}


def test_a_catalog_is_read_by_its_headers(spark, tmp_path):
    file = tmp_path / "catalog.csv"
    file.write_text("table,column,data_type,description,source_stage,transformation_applied,pii\nt,c,int,what it is,made,\"filled, then cut\",yes\n")
    row = governance.read_dictionary(spark, str(file)).first().asDict()
    assert row == {
        "table": "t", "column": "c", "data_type": "int", "description": "what it is", "source_stage": "made",
        "transformation_applied": "filled, then cut", "pii": "yes",
    }
    file.write_text("pii, Column ,table\nno,c,t\n")
    row = governance.read_dictionary(spark, str(file)).first()
    assert (row.table, row.column, row.pii, row.description) == ("t", "c", "no", None)
    for wrong in ("table,column,owner\nt,c,x\n", "table,pii\nt,no\n"):
        file.write_text(wrong)
        with pytest.raises(ValueError, match="no column catalog"):
            governance.read_dictionary(spark, str(file))


def test_every_column_has_a_step_or_came_in(spark, finished):
    pipeline, _ = finished
    held = {t: df for tables in pipeline._held(pipeline.read("staging/validated_orders")).values() for t, df in tables.items()}
    profile = governance.column_profile(held)
    steps = governance.column_lineage(profile).collect()
    named = {(r.table, r.column) for r in steps}
    assert {(t, c) for t, df in held.items() for c in df.columns} - named == {("raw_orders", c) for c in held["raw_orders"].columns}
    assert all(r.source_column in held[r.source_table].columns for r in steps)
    assert {(t, c) for t, c in governance.MADE} <= named


def test_dictionary_round_trip_and_coverage(spark, orders):
    path = new_folder(spark, "dictionary")
    dictionary = governance.data_dictionary(spark)
    write_csv(dictionary, path)
    assert governance.read_dictionary(spark, path).select(dictionary.columns).exceptAll(dictionary).isEmpty()
    held = governance.column_profile(
        {"raw_orders": orders({"region": None}, {}), "validated_orders": orders({}), "fact_orders": warehouse.fact_orders(orders({}))}
    )
    missing = {(r.table, r.column) for r in governance.undocumented_columns(dictionary, held).collect()}
    assert missing == {("fact_orders", c) for c in ("customer_id", "product_id", "order_date", "region", "payment_method", "quantity", "unit_price")}
    personal = {(r.table, r.column) for r in governance.pii_columns(dictionary, held).collect()}
    assert ("raw_orders", "customer_email") in personal and len(personal) == 12
    region = [r for r in held.collect() if (r.table, r.column) == ("raw_orders", "region")][0]
    assert (region.rows, region.nulls) == (2, 1)
