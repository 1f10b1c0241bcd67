"""Tables published by version: readers see the last whole one, however a write ends.

A version is written to a folder of its own. When it is complete, one small record with the next
number makes it current; dropping a table is such a record too. Readers take the highest number, so
they see the old version or the new one and never a part. A version that failed, or that another
writer overtook, is just not pointed at. Of two writers that take the same number at once, one
fails to place its record and takes the next.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession

from orderflow.sources import files
from orderflow.sources.counted import write_observed
from orderflow.sources.shared_folder import TABLE_CODEC

RECORDS = "current"
RECORD_SCHEMA = "number bigint, version string, rows bigint, published timestamp, notes map<string, bigint>"


class NoSuchTable(LookupError):
    """Nothing is published under a path, or what was has been dropped."""


def _records(spark: SparkSession, path: str) -> list[str]:
    return [n for n in files.names(spark, f"{path}/{RECORDS}") if n.endswith(".json") and n[0].isdigit()]


def _last(spark: SparkSession, path: str) -> dict:
    """The record that counts; one without a version if there is none."""
    known = _records(spark, path)
    return json.loads(files.read_text(spark, f"{path}/{RECORDS}/{known[-1]}")) if known else {"version": None}


def _point(spark: SparkSession, path: str, version: str | None, found: Mapping[str, int | None]) -> None:
    while True:
        known = _records(spark, path)
        number = int(known[-1].removesuffix(".json")) + 1 if known else 1
        record = {"number": number, "version": version, "rows": found.get("rows"), "published": datetime.now(timezone.utc).isoformat()}
        record["notes"] = {name: total for name, total in found.items() if name != "rows"}
        if files.write_text(spark, f"{path}/{RECORDS}/{number:012d}.json", json.dumps(record)):
            return


def publish(df: DataFrame, path: str, notes: Mapping[str, tuple[str, Column]] | None = None) -> int:
    """Write ``df`` as a new version of the table at ``path`` and make it current; rows written.

    The totals of ``notes`` (see ``write_observed``) are kept with the version.
    """
    version = uuid4().hex
    found = write_observed(df, lambda d: d.write.option("compression", TABLE_CODEC).parquet(f"{path}/versions/{version}"), notes or {})
    _point(df.sparkSession, path, version, found)
    return found["rows"]


def is_published(spark: SparkSession, path: str) -> bool:
    return _last(spark, path)["version"] is not None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    version = _last(spark, path)["version"]
    if version is None:
        raise NoSuchTable(path)
    return spark.read.parquet(f"{path}/versions/{version}")


def notes(spark: SparkSession, path: str) -> dict[str, int | None]:
    """The rows of the current version and the totals noted when it was written."""
    last = _last(spark, path)
    if last["version"] is None:
        raise NoSuchTable(path)
    return {"rows": last["rows"], **last["notes"]}


def drop(spark: SparkSession, path: str) -> None:
    """Leave no version current. A table that is not there, or dropped already, stays so."""
    if is_published(spark, path):
        _point(spark, path, None, {})


def history(spark: SparkSession, path: str) -> DataFrame:
    """(number, version, rows, published) of everything published under a path; a drop has no version."""
    if not _records(spark, path):
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.schema(RECORD_SCHEMA).json(f"{path}/{RECORDS}")
