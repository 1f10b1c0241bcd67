"""The lineage log: one JSON record per attempt at a stage, append-only.

A record's file is named by run, stage and attempt, so writing it again changes nothing. Of several
attempts the last one counts. ``compact`` gathers the records in one published table, behind which only later
records are single files; a record that is found in both places counts once.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orderflow.fixed_values import LINEAGE_FIELDS
from orderflow.sources import files, versions

LINEAGE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LINEAGE_FIELDS) + ", attempt bigint"

RECORDS, COMPACTED = "records", "compacted"

#: Single records that one file of the compacted table takes in.
COMPACT_RECORDS = 100_000


def _name(run_id: str, stage: str, attempt: int) -> str:
    return f"{quote(run_id, safe='')}.{quote(stage, safe='').replace('.', '%2E')}.{attempt}.json"


def append_record(spark: SparkSession, record: Mapping[str, Any], path: str) -> bool:
    """Add one record to the log folder, creating it if needed; False if it is there already."""
    name = _name(record["run_id"], record["stage"], record["attempt"])
    return files.write_text(spark, f"{path}/{RECORDS}/{name}", json.dumps(dict(record)))


def next_attempt(spark: SparkSession, path: str, run_id: str, stage: str) -> int:
    """The number of the next attempt of a run at a stage."""
    head = _name(run_id, stage, 0).removesuffix("0.json")
    known = [int(n[len(head) :].removesuffix(".json")) for n in files.names(spark, f"{path}/{RECORDS}") if n.startswith(head)]
    if versions.is_published(spark, f"{path}/{COMPACTED}"):
        held = versions.current(spark, f"{path}/{COMPACTED}").where((F.col("run_id") == run_id) & (F.col("stage") == stage))
        known.append(held.agg(F.max("attempt")).first()[0] or 0)
    return max(known, default=0) + 1


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    """Every attempt of every run, some records maybe twice."""
    schema = StructType.fromDDL(LINEAGE_SCHEMA)
    found = spark.createDataFrame([], schema)
    if files.names(spark, f"{path}/{RECORDS}"):
        found = spark.read.schema(schema).json(f"{path}/{RECORDS}")
    if versions.is_published(spark, f"{path}/{COMPACTED}"):
        found = versions.current(spark, f"{path}/{COMPACTED}").unionByName(found)
    return found


def _filled(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "columns": F.coalesce("columns", F.array().cast("array<string>")),
            "extra": F.coalesce("extra", F.lit("{}")),
            "rows_dropped": F.col("rows_in") - F.col("rows_out"),
            "attempt": F.coalesce("attempt", F.lit(1).cast("bigint")),
        }
    )


def read_log(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """The last attempt at every stage of every run. ``array_file`` reads one JSON array instead."""
    if array_file:
        return _filled(spark.read.schema(LINEAGE_SCHEMA).option("multiLine", True).json(path))
    log = _filled(_attempts(spark, path))
    others = [c for c in log.columns if c not in ("run_id", "stage")]
    last = log.groupBy("run_id", "stage").agg(F.max_by(F.struct(*others), F.struct("attempt", "timestamp")).alias("last"))
    return last.select("run_id", "stage", "last.*").select(*log.columns)


def compact(spark: SparkSession, path: str) -> int:
    """Publish all records as one table and remove their single files; how many files went.

    Records that come meanwhile keep their files. Until the files have gone readers find records twice.
    """
    single = files.names(spark, f"{path}/{RECORDS}")
    if single:
        attempts = _filled(_attempts(spark, path)).dropDuplicates(["run_id", "stage", "attempt"])
        versions.publish(attempts.coalesce(1 + len(single) // COMPACT_RECORDS), f"{path}/{COMPACTED}")
        files.remove(spark, [f"{path}/{RECORDS}/{name}" for name in single])
    return len(single)


def flatten_log(log: DataFrame) -> DataFrame:
    """The log with every field as plain text or number, fit for CSV."""
    return log.drop("attempt").withColumns(
        {
            "columns": F.to_json("columns"),
            "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        }
    )
