"""Quality profile, score and reports.

The profile is one row of counts. Copies are counted first with a grouping on all
columns of the rows that may have an equal, whose map-side half collapses a group of copies before the
shuffle however large the group is; every other count is then a weighted sum over distinct rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.operators.repeats import split

COPIES = "_copies"
Rules = Mapping[str, Column]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def with_copies(df: DataFrame) -> DataFrame:
    """Distinct rows and how often each occurs; nulls equal nulls."""
    alone, others = split(df)
    counted = others.groupBy(*[_col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(COPIES))
    return alone.withColumn(COPIES, F.lit(1).cast("bigint")).union(counted)


def duplicate_sets(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with the number of members of each set."""
    return with_copies(df).where(F.col(COPIES) > 1).withColumnRenamed(COPIES, "copies")


def members(df: DataFrame) -> DataFrame:
    """Every row of ``df`` with its number among equal rows, from 1, and how many there are."""
    columns = df.columns
    copies = with_copies(df).withColumnRenamed(COPIES, "copies")
    return copies.select(*[_col(c) for c in columns], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("member"), "copies")


def duplicate_members(df: DataFrame) -> DataFrame:
    """Every member of a set of equal rows, the first included."""
    return members(df).where("copies > 1")


def issue_rows(df: DataFrame, rules: Rules) -> DataFrame:
    """Every row with its number among equal rows and whether anything is wrong with it."""
    flag = has_issue(df.columns, rules, F.col("copies") > 1)
    return members(df).withColumn("has_issue", flag).drop("copies")


def has_issue(columns: Sequence[str], rules: Rules, duplicated: Column) -> Column:
    """Any null, any duplicate, or any failed rule."""
    flag = duplicated
    for c in columns:
        flag = flag | _col(c).isNull()
    for passes in rules.values():
        flag = flag | ~passes
    return flag


def _cell_counts(columns: Sequence[str], rules: Rules, copies: Column) -> dict[str, Column]:
    """What a row adds to the null count of each column and the pass count of each rule."""
    nulls = {f"nulls:{c}": _col(c).isNull() for c in columns}
    passes = {f"valid:{name}": ok for name, ok in rules.items()}
    return {name: F.when(counts, copies).otherwise(0) for name, counts in (nulls | passes).items()}


def row_counts(columns: Sequence[str], rules: Rules, copies: Column) -> dict[str, Column]:
    """What a distinct row that occurs ``copies`` times adds to each profile count."""
    return {
        "rows": copies,
        "later_duplicates": copies - 1,
        "issue_rows": F.when(has_issue(columns, rules, copies > 1), copies).otherwise(0),
        **_cell_counts(columns, rules, copies),
    }


def totals(names: Iterable[str]) -> list[Column]:
    return [F.coalesce(F.sum(_col(n)), F.lit(0)).cast("bigint").alias(n) for n in names]


def _add_up(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    return df.select([c.alias(n) for n, c in counts.items()]).agg(*totals(counts))


def cell_profile(df: DataFrame, rules: Rules) -> DataFrame:
    """Row count, nulls per column and passes per rule: one scan, no keyed shuffle."""
    one = F.lit(1).cast("bigint")
    return _add_up(df, {"rows": one, **_cell_counts(df.columns, rules, one)})


def row_profile(df: DataFrame, rules: Rules) -> DataFrame:
    """The cell profile plus later duplicates and rows with any issue."""
    return _add_up(with_copies(df), row_counts(df.columns, rules, F.col(COPIES)))


def at_hand(small: DataFrame) -> DataFrame:
    """The same rows, held by the driver: for profiles and reports of one row a column or metric."""
    return small.sparkSession.createDataFrame([tuple(r) for r in small.collect()], small.schema)


def null_audit(profile: DataFrame) -> DataFrame:
    """(column, nulls) from a profile."""
    columns = [c for c in profile.columns if c.startswith("nulls:")]
    named = profile.select([_col(c).alias(c.removeprefix("nulls:")) for c in columns])
    return named.unpivot([], named.columns, "column", "nulls")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _percent(ratio: Column) -> Column:
    return F.round(ratio * 100, 2)


def pass_shares(profile: DataFrame) -> DataFrame:
    """Share of rows that pass each rule; null for an empty table."""
    rules = [c for c in profile.columns if c.startswith("valid:")]
    return profile.select(
        "rows",
        *[_share(_col(c), F.col("rows")).alias(f"{c.removeprefix('valid:')}_valid") for c in rules],
    )


def issue_share(profile: DataFrame) -> DataFrame:
    return profile.select(
        "rows", "issue_rows", _percent(_share(F.col("issue_rows"), F.col("rows"))).alias("issue_pct")
    )


def quality_score(profile: DataFrame) -> DataFrame:
    """Score 0-100: the mean of completeness, uniqueness and validity, with its parts."""
    nulls = [_col(c) for c in profile.columns if c.startswith("nulls:")]
    rules = [_col(c) for c in profile.columns if c.startswith("valid:")]
    rows = F.col("rows")
    null_cells = sum(nulls[1:], nulls[0])
    shares = [_share(ok, rows) for ok in rules]
    parts = profile.select(
        "rows",
        "later_duplicates",
        _percent(_share(F.col("issue_rows"), rows)).alias("issue_pct"),
        (1 - _share(null_cells, rows * len(nulls))).alias("completeness"),
        (1 - _share(F.col("later_duplicates"), rows)).alias("uniqueness"),
        (sum(shares[1:], shares[0]) / len(shares)).alias("validity"),
    )
    mean = (F.col("completeness") + F.col("uniqueness") + F.col("validity")) / 3
    return parts.select(
        "rows",
        "later_duplicates",
        "issue_pct",
        _percent(mean).alias("quality_score"),
        _percent(F.col("completeness")).alias("completeness_pct"),
        _percent(F.col("uniqueness")).alias("uniqueness_pct"),
        _percent(F.col("validity")).alias("validity_pct"),
    )


def null_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nulls per column before and after cleaning, from two profiles."""
    return null_audit(before).select("column", F.col("nulls").alias("nulls_before_cleaning")).join(
        null_audit(after).select("column", F.col("nulls").alias("nulls_after_cleaning")),
        "column",
        "left",
    )


def score_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, value): both scores, their parts, and what cleaning removed.

    ``pct_rows_with_any_issue_after`` is 0.0 by definition; the measured share is
    reported next to it as ``..._after_actual``.
    """
    scores = quality_score(before).withColumn("phase", F.lit("before")).unionByName(
        quality_score(after).withColumn("phase", F.lit("after"))
    )
    names = [c for c in scores.columns if c != "phase"]
    both = scores.agg(
        *[
            F.max(F.when(F.col("phase") == phase, F.col(c))).alias(f"{phase}:{c}")
            for phase in ("before", "after")
            for c in names
        ]
    )

    def v(name: str) -> Column:
        return _col(name).cast("double")

    metrics = {
        "quality_score_before": v("before:quality_score"),
        "quality_score_after": v("after:quality_score"),
        "improvement_points": F.round(v("after:quality_score") - v("before:quality_score"), 2),
        "pct_rows_with_any_issue_before": v("before:issue_pct"),
        "pct_rows_with_any_issue_after": F.lit(0.0),
        "pct_rows_with_any_issue_after_actual": v("after:issue_pct"),
        "duplicate_rows_removed": v("before:later_duplicates"),
        "rows_before": v("before:rows"),
        "rows_after": v("after:rows"),
        "rows_dropped_total": v("before:rows") - v("after:rows"),
        "completeness_before_pct": v("before:completeness_pct"),
        "completeness_after_pct": v("after:completeness_pct"),
        "uniqueness_before_pct": v("before:uniqueness_pct"),
        "uniqueness_after_pct": v("after:uniqueness_pct"),
        "validity_before_pct": v("before:validity_pct"),
        "validity_after_pct": v("after:validity_pct"),
    }
    wide = both.select([value.alias(name) for name, value in metrics.items()])
    return wide.unpivot([], list(metrics), "metric", "value")
