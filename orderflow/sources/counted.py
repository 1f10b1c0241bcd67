"""Writes that report what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orderflow.operators.names import free_prefix

#: How the values of a noted column are put together: as bits or as a sum.
TOTALS = {"bits": F.bit_or, "sum": lambda c: F.sum(c).cast("bigint")}


def write_counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Run ``write`` on ``df`` and count the rows on their way to the sink."""
    return write_observed(df, write, {})["rows"]


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], notes: Mapping[str, tuple[str, Column]]) -> dict[str, int | None]:
    """Run ``write`` on ``df``; the number of ``rows`` and of each note its total on their way to the sink.

    A note is a kind of TOTALS and a column. The totals sit on top of the plan, in the stage that writes, where Spark
    applies the update of a task once however often the task is retried. An
    input known to be empty may drop the observed node; nothing is reported then.
    """
    own = free_prefix(df.columns)
    held = {name: f"{own}{i}" for i, name in enumerate(notes)}
    # Plain columns first: an observed expression is not compiled with the rest of the stage.
    wide = df.withColumns({held[name]: cell for name, (_, cell) in notes.items()}) if notes else df
    seen = Observation()
    totals = [TOTALS[kind](F.col(held[name])).alias(name) for name, (kind, _) in notes.items()]
    write(wide.observe(seen, F.count(F.lit(1)).alias("rows"), *totals).drop(*held.values()))
    found = seen.get
    return {"rows": found.get("rows", 0), **{name: found.get(name) for name in notes}}
