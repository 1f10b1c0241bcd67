"""Exact medians over counted values, with bounded groups.

``median`` keeps a map of all distinct values of a group in one task. Here the values are
counted first, map-side combined and spread over tasks by value. They are then summed per
value bucket and only the bucket with the middle goes on: first buckets of 1/256 of a factor e,
then, twice, 65,536 equal parts between the smallest and the largest value of the bucket kept.
A bucket of the first kind holds at most 2^44 different DOUBLEs, so after both refinements at
most some 2^12 are left to be ranked, whatever the data. Groups that have no more counts than
that to begin with are ranked as they are, in one shuffle. No task sorts a whole larger group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.sources.shared_folder import stage

# A first bucket spans 1/256 of a factor e. The exponent range of a DOUBLE bounds the
# number of buckets of a group; money fills a few thousand of them.
_BUCKETS_PER_E = 256
_OFFSET = 1_000_000
_INFINITE = 1 << 40

# A refinement cuts the range that is left into this many parts.
_PARTS = 1 << 16

# Groups of at most this many counts are ranked without buckets.
_RANKED = 1 << 12


def value_bucket(value: Column) -> Column:
    """A BIGINT that never decreases as the value grows."""
    size = F.abs(value)
    step = F.when(size == float("inf"), F.lit(_INFINITE)).otherwise(F.floor(F.ln(size) * _BUCKETS_PER_E) + _OFFSET)
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0).cast("bigint"))


def _part(value: Column) -> Column:
    """The part of ``_least`` to ``_most`` that a value falls in; never decreases as the value grows."""
    share = F.try_divide(value - F.col("_least"), F.col("_most") - F.col("_least"))
    return F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1))


def _middle(counts: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """(keys, _least, _most, _before, _total, _settled) of the bucket with the middle of each group.

    ``counts`` has (keys, _value, _n) and, if it is a part of the groups, _before and _total: how many
    values are smaller than all those given, and how many the whole group has. Two middle values in
    two buckets are the largest of one and the smallest of the other, so they are settled.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    known = [c for c in ("_before", "_total") if c in counts.columns]
    per_bucket = (
        counts.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket", *known)
        .agg(F.sum("_n").alias("_in_bucket"), F.min("_value").alias("_first"), F.max("_value").alias("_last"))
    )
    if not known:
        per_bucket = per_bucket.withColumns(
            {"_before": F.lit(0).cast("bigint"), "_total": F.sum("_in_bucket").over(group)}
        )
    ranked = per_bucket.withColumn("_upto", F.col("_before") + F.sum("_in_bucket").over(upto)).withColumn(
        "_under", F.col("_upto") - F.col("_in_bucket")
    )
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    one = F.count(F.lit(1)) == 1
    return (
        ranked.where((F.col("_under") <= high) & (F.col("_upto") > low))
        .groupBy(*keys)
        .agg(
            F.when(one, F.min("_first")).otherwise(F.min("_last")).alias("_least"),
            F.when(one, F.max("_last")).otherwise(F.max("_first")).alias("_most"),
            F.min("_under").alias("_before"),
            F.first("_total").alias("_total"),
            (~one | (F.min("_first") == F.max("_last"))).alias("_settled"),
        )
    )


def _ranked_medians(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _least, _most) of the middle values of small groups."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(group)})
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    middle = ranked.where((F.col("_upto") - F.col("_n") <= high) & (F.col("_upto") > low))
    return middle.groupBy(*keys).agg(F.min("_value").alias("_least"), F.max("_value").alias("_most"))


def _by_size(counts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The counts of small groups and of the others; None if there are no others, of which there are never many."""
    large = stage(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > _RANKED).select(*keys), "large_groups")
    if large.isEmpty():
        return counts, None
    return counts.join(large, list(keys), "left_anti"), counts.join(large, list(keys), "left_semi")


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the middle value, or the mean of the middle two.

    ``counts`` gives the number of times a value occurs; a (keys, value) may come several times,
    null values do not count. It is read once per step, so it should be cheap to scan again. In large groups two steps
    are one plan, whose first exchange serves both, and write a row per group; only a group whose middle still
    lies among many values is looked at again.
    """
    known = counts.where(F.col(value).isNotNull()).select(
        *([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), F.col(value).alias("_value"), F.col(weight).alias("_n")
    )
    by = list(keys) or ["_all"]
    exact = F.col("_value")

    def within(middle: DataFrame) -> DataFrame:
        unsettled = middle.where("NOT _settled").drop("_settled")
        return known.join(unsettled if keys else F.broadcast(unsettled), by).where("_value BETWEEN _least AND _most")

    found = []
    if keys:
        small, known = _by_size(known, keys)
        found.append(_ranked_medians(small, keys))
    if known is None:
        return _mean_of_middle(found, keys)
    part = known
    for coarse, fine in ((value_bucket(exact), _part(exact)), (_part(exact), exact)):
        first = _middle(part, by, coarse)
        both = stage(first.where("_settled").unionByName(_middle(within(first), by, fine)), "middles")
        found.append(both.where("_settled"))
        if both.where("NOT _settled").isEmpty():
            break
        part = within(both)
    return _mean_of_middle(found, keys)


def _mean_of_middle(found: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    middles = [m.select(*keys, "_least", "_most") for m in found]
    medians = reduce(DataFrame.unionByName, middles)
    return medians.select(*keys, ((F.col("_least") + F.col("_most")) / 2).alias("median"))
