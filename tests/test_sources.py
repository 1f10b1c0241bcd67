import json
from datetime import datetime, timezone

import pytest

from pyspark.sql import functions as F

from orderflow.plans.lineage import StageRun, lineage_edges, lineage_upstream, run_violations
from orderflow.sources import csv_files, files, lineage_log, shared_folder, versions
from orderflow.sources.counted import write_counted
from orderflow.sources.jobs import run_together


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_keeps_text_untouched(spark):
    path = shared_folder.new_folder(spark, "csv")
    values = [(" padded ", 'say "hi"'), ("a,b", "tab\t"), ("line\nbreak", "x\\y"), (None, "'"), ("é", "z\n")]
    df = spark.createDataFrame(values, "a string, b string")
    csv_files.write_csv(df, path)
    assert rows(csv_files.read_csv(spark, path)) == rows(df)


def test_plain_csv_stays_splittable(spark):
    path = shared_folder.new_folder(spark, "csv")
    csv_files.write_csv(spark.createDataFrame([('say "hi"', "a,b")], "a string, b string"), path)
    assert csv_files.files_with_quoted_newlines(spark, path) == []


def test_multi_line_is_detected(spark):
    path = shared_folder.new_folder(spark, "csv")
    csv_files.write_csv(spark.createDataFrame([("a\nb", "c")], "a string, b string"), path)
    assert len(csv_files.files_with_quoted_newlines(spark, path)) == 1


def test_one_file_with_line_breaks_leaves_the_others_splittable(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"plain {k}.csv").write_text("a,b\n" + "".join(f"{i},x{k}\n" for i in range(20_000)))
    (tmp_path / "broken%20.csv").write_text('b,a\n'.replace("b,a", "a,b") + '"one\ntwo","say ""hi"""\n7,NA\n')
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        out = csv_files.read_csv(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() >= 8  # each plain file is cut, the broken one is not
        assert out.count() == 60_002
        assert rows(out.where("b is null or b like 'say%'")) == [("7", None), ("one\ntwo", 'say "hi"')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_missing_value_tokens_and_blank_lines(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text('Order ID,Name\n1,NA\n\n2,""\n3,none\n,"n/a"\n')
    out = csv_files.read_csv(spark, str(file))
    assert rows(out) == sorted([("1", None), ("2", None), ("3", "none"), (None, None)], key=repr)


def test_a_record_longer_than_the_header_stops_the_read(spark, tmp_path):
    file = tmp_path / "long.csv"
    file.write_text('a,b\n1,2\n3\n"x, y","say ""hi"""\n')
    out = csv_files.read_csv(spark, str(file))
    assert rows(out) == sorted([("1", "2"), ("3", None), ("x, y", 'say "hi"')], key=repr) and out.count() == 3
    file = tmp_path / "longer.csv"
    file.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more fields than the header"):
        csv_files.read_csv(spark, str(file)).collect()


def test_written_rows_are_counted(spark):
    path = shared_folder.new_folder(spark, "counted")
    df = spark.range(1000).repartition(5)
    assert write_counted(df, lambda d: d.write.parquet(path)) == 1000
    assert spark.read.parquet(path).count() == 1000


def test_an_empty_write_counts_zero(spark):
    path = shared_folder.new_folder(spark, "counted")
    df = spark.range(10).where("id > 50").distinct()
    assert write_counted(df, lambda d: d.write.parquet(path)) == 0


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder.shared_folder(spark) == named.rstrip("/")
    assert shared_folder.new_folder(spark, "x") != shared_folder.new_folder(spark, "x")


def test_jobs_side_by_side(spark):
    out = run_together(spark, {n: lambda n=n: spark.range(n).count() for n in (3, 5, 7)})
    assert out == {3: 3, 5: 5, 7: 7}


def test_a_failing_job_is_raised(spark):
    def fail():
        raise KeyError("gone")

    with pytest.raises(KeyError):
        run_together(spark, {"ok": lambda: 1, "bad": fail})


def test_a_table_is_replaced_by_version(spark):
    path = shared_folder.new_folder(spark, "published")
    with pytest.raises(versions.NoSuchTable):
        versions.current(spark, path)
    assert versions.publish(spark.range(3), path) == 3
    old = versions.current(spark, path)
    fails = spark.range(9).where(F.when(F.col("id") == 8, F.raise_error(F.lit("stop")).cast("boolean")).otherwise(F.lit(True)))
    with pytest.raises(Exception, match="stop"):
        versions.publish(fails, path)
    assert versions.current(spark, path).count() == 3
    versions.publish(spark.range(5), path, {"odd": ("sum", F.col("id") % 2)})
    assert versions.current(spark, path).count() == 5 and old.count() == 3
    assert versions.notes(spark, path) == {"rows": 5, "odd": 2}
    versions.drop(spark, path)
    versions.drop(spark, path)
    assert not versions.is_published(spark, path)
    assert [(r.number, r.rows) for r in versions.history(spark, path).orderBy("number").collect()] == [(1, 3), (2, 5), (3, None)]
    versions.publish(spark.range(0), path)
    assert versions.current(spark, path).count() == 0


def test_a_small_file_is_written_once(spark):
    path = shared_folder.new_folder(spark, "note")
    assert files.names(spark, path) == []
    assert files.write_text(spark, f"{path}/a.json", "é1") and not files.write_text(spark, f"{path}/a.json", "2")
    assert files.read_text(spark, f"{path}/a.json") == "é1" and files.names(spark, path) == ["a.json"]


def test_derived_tables_follow_their_folder(spark, tmp_path):
    from orderflow import registry

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    built = []
    for _ in range(2):
        registry._once(spark, str(tmp_path), "thing", lambda: built.append(1))
    spark.range(2).write.parquet(str(tmp_path / "u.parquet"))
    registry._once(spark, str(tmp_path), "thing", lambda: built.append(2))
    assert built == [1, 2]


def log(spark, path, source, target, rows_in=5, rows_out=3, run_id="r1", attempt=None, stage=None):
    done = StageRun(run_id, stage or f"{source}>{target}", source, target, rows_in, rows_out, ("a", "b"), extra={"k": [1]}, attempt=attempt)
    return done.log(spark, path)


def test_a_stage_logged_twice_counts_once(spark):
    path = shared_folder.new_folder(spark, "log")
    assert log(spark, path, "a", "b", attempt=1) and not log(spark, path, "a", "b", attempt=1)
    log(spark, path, "a", "b", 7, 6)  # another attempt
    found = lineage_log.read_log(spark, path).collect()
    assert [(r.attempt, r.rows_in, r.rows_dropped) for r in found] == [(2, 7, 1)]
    for k in range(40):
        log(spark, path, "a", "b", k, 0, run_id=f"run.{k}", stage="a.b/c")
    assert lineage_log.read_log(spark, path).count() == 41
    assert lineage_log.compact(spark, path) == 42 and files.names(spark, f"{path}/records") == []
    assert lineage_log.read_log(spark, path).count() == 41
    log(spark, path, "a", "b", 8, 8)
    assert lineage_log.next_attempt(spark, path, "r1", "a>b") == 4
    again = {r.run_id: r for r in lineage_log.read_log(spark, path).collect()}
    assert again["r1"].attempt == 3 and again["r1"].rows_in == 8 and len(again) == 41
    assert lineage_log.compact(spark, path) == 1 and lineage_log.compact(spark, path) == 0
    assert len(lineage_log.read_log(spark, path).inputFiles()) == 1


def test_records_that_do_not_fit_together(spark):
    path = shared_folder.new_folder(spark, "log")
    times = ["2024-01-01T00:00:00+00:00", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00+01:00"]
    chain = [("1", "a", "b", 5, 5), ("2", "b", "c", 5, 4), ("3", "c", "d", 3, -1)]
    for (stage, source, target, rows_in, rows_out), time in zip(chain, times):
        StageRun("0123abcd", stage, source, target, rows_in, rows_out, timestamp=time).log(spark, path)
    StageRun("0123ABCD", "1", "a", "b", 5, 5).log(spark, path)
    found = rows(run_violations(lineage_log.read_log(spark, path)))
    assert found == [
        ("0123ABCD", "1", "run id is not 8 hexadecimal digits"), ("0123abcd", "3", "rows are negative or missing"),
        ("0123abcd", "3", "rows read are not those written"), ("0123abcd", "3", "time goes back"),
    ]


def test_log_is_appended_and_read_back(spark):
    path = shared_folder.new_folder(spark, "log")
    before = datetime.now(timezone.utc).replace(tzinfo=None)
    log(spark, path, "a", "b")
    log(spark, path, "a", "b", 9, 1, "r2")
    found = lineage_log.read_log(spark, path).orderBy("run_id").collect()
    assert [(r.run_id, r.rows_in, r.rows_out, r.rows_dropped) for r in found] == [("r1", 5, 3, 2), ("r2", 9, 1, 8)]
    assert found[0].columns == ["a", "b"] and json.loads(found[0].extra) == {"k": [1]}
    assert found[0].timestamp >= before.replace(microsecond=0)
    flat = lineage_log.flatten_log(lineage_log.read_log(spark, path)).first()
    assert flat.columns == '["a","b"]' and flat.timestamp.endswith(("Z", "+00:00"))


def test_log_kept_as_one_json_array(spark, tmp_path):
    file = tmp_path / "log.json"
    record = {
        "run_id": "ab12cd34", "stage": "s", "timestamp": "2024-05-01T10:00:00.123456+00:00",
        "source": "a", "target": "b", "rows_in": 4, "rows_out": 3, "rows_dropped": 1,
        "columns": [], "transformation": "t", "extra": {"files": ["x", "y"], "n": 1.5},
    }
    file.write_text(json.dumps([record, record | {"columns": None, "extra": None}], indent=2))
    found = lineage_log.read_log(spark, str(file), array_file=True).collect()
    assert len(found) == 2 and found[0].timestamp == datetime(2024, 5, 1, 10, 0, 0, 123456)
    assert [r.extra for r in found if r.extra != "{}"] and all(r.columns == [] for r in found)
    full = next(r for r in found if r.extra != "{}")
    assert json.loads(full.extra) == record["extra"]


def test_edges_and_upstream(spark):
    path = shared_folder.new_folder(spark, "log")
    for source, target in [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "a")]:
        log(spark, path, source, target)
    log(spark, path, "d", "e", run_id="r2")
    records = lineage_log.read_log(spark, path)
    edges = {(r.source, r.target): (r.runs, r.rows_dropped) for r in lineage_edges(records).collect()}
    assert edges[("d", "e")] == (2, 4) and len(edges) == 6
    found = {r.ancestor: r.distance for r in lineage_upstream(records, "e").collect()}
    assert found == {"d": 1, "b": 2, "c": 2, "a": 3, "e": 4}
    assert lineage_upstream(records, "nowhere").isEmpty()


def test_branches_that_join_again_do_not_multiply(spark):
    edges = [(f"{k}{side}", f"{k + 1}{other}") for k in range(30) for side in "xyz" for other in "xyz"]
    edges = spark.createDataFrame(edges, "source string, target string")
    found = {r.ancestor: r.distance for r in lineage_upstream(edges, "30x").collect()}
    assert len(found) == 90 and found["0y"] == 30
