"""Lineage: what the stages of a run did, the edges between tables, where a table came from."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.fixed_values import STAGE_REPORTS
from orderflow.sources import lineage_log


def new_run_id() -> str:
    return uuid4().hex[:8]


@dataclass(frozen=True)
class StageRun:
    """One attempt at a stage. ``extra`` is whatever the stage notes about itself."""

    run_id: str
    stage: str
    source: str
    target: str
    rows_in: int
    rows_out: int
    columns: tuple[str, ...] = ()
    transformation: str = ""
    extra: Mapping[str, Any] = field(default_factory=dict)
    attempt: int | None = None
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def log(self, spark: SparkSession, path: str) -> bool:
        """Append to the log at ``path``; without a number, as the next attempt. False: logged before."""
        attempt = self.attempt or lineage_log.next_attempt(spark, path, self.run_id, self.stage)
        noted = {"columns": list(self.columns), "extra": json.dumps(dict(self.extra)), "attempt": attempt}
        return lineage_log.append_record(spark, {**vars(self), **noted}, path)


def lineage_columns(log: DataFrame) -> DataFrame:
    """(run_id, stage, target, column): every column a stage wrote."""
    return log.select("run_id", "stage", "target", F.explode("columns").alias("column"))


def lineage_edges(log: DataFrame) -> DataFrame:
    """One row per source -> target, over all runs."""
    return log.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("rows_dropped").alias("rows_dropped"),
        F.max("timestamp").alias("last_run"),
    )


_UPSTREAM = """
WITH RECURSIVE found (ancestor, distance) MAX RECURSION LEVEL {levels} AS (
  SELECT DISTINCT source, 1 FROM {edges} WHERE target = :start
  UNION ALL
  SELECT DISTINCT e.source, distance + 1 FROM found JOIN {edges} e ON e.target = ancestor WHERE distance < {longest}
)
SELECT ancestor, min(distance) AS distance FROM found GROUP BY ancestor
"""


def upstream(edges: DataFrame, start: str) -> DataFrame:
    """(ancestor, distance): everything that ``start`` was derived from along (source, target) edges.

    One recursive query. A step holds each name once, and no way needs more steps than there are targets: so
    cycles end, and joining branches do not multiply. Without cycles it ends when the last branch does.
    """
    edges = edges.select("source", "target").distinct()
    longest = edges.select("target").distinct().count()
    return edges.sparkSession.sql(_UPSTREAM, args={"start": start}, edges=edges, longest=longest, levels=longest + 2)


def lineage_upstream(log: DataFrame, table: str) -> DataFrame:
    """(ancestor, distance): every table ``table`` was derived from."""
    return upstream(log, table)


def run_violations(log: DataFrame) -> DataFrame:
    """(run_id, stage, violation): where the records of a run do not fit together.

    A run id has 8 lower-case hexadecimal digits; times are in the order of the stages; no count is negative;
    a stage that reads what the stage before wrote reads as many rows (the export
    counts rows of reports and is left out); a stage's source is the target of the one before.
    """
    run = Window.partitionBy("run_id").orderBy("stage")
    seen = log.withColumns({f"last_{c}": F.lag(c).over(run) for c in ("timestamp", "rows_out", "target")})
    checks: dict[str, Column] = {
        "run id is not 8 hexadecimal digits": ~F.coalesce(F.col("run_id").rlike("^[0-9a-f]{8}$"), F.lit(False)),
        "time is missing": F.col("timestamp").isNull(),
        "time goes back": F.col("timestamp") < F.col("last_timestamp"),
        "rows are negative or missing": F.coalesce((F.col("rows_in") < 0) | (F.col("rows_out") < 0), F.lit(True)),
        "source is not the last target": F.col("source") != F.col("last_target"),
        "rows read are not those written": (F.col("stage") != STAGE_REPORTS) & (F.col("rows_in") != F.col("last_rows_out")),
    }
    found = F.filter(F.array(*[F.when(broken, name) for name, broken in checks.items()]), lambda v: v.isNotNull())
    return seen.select("run_id", "stage", F.explode(found).alias("violation"))
