"""Profiling the raw orders and cleaning them in one pass.

Scoring needs the copies of each raw row counted; cleaning needs the copies left after
the fills removed. Each groups whole rows, those that may have an equal, so here
they share it: rows are filled first and marked with the cells that were missing. Equal
filled rows with equal marks are the copies of one raw row, so counting per mark and
filled row serves both.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from orderflow.operators.clean import (
    PriceFills,
    drop_null_email,
    fill_unknown,
    finish,
    impute_unit_price,
    price_counts,
    price_fills,
)
from orderflow.operators.names import free_prefix
from orderflow.operators.profile import row_counts, row_profile, totals
from orderflow.operators.repeats import split
from orderflow.sources.shared_folder import stage
from orderflow.sources.versions import publish

# Columns the fills write to; a mark has one bit per column.
FILLED = ("product_category", "region", "unit_price")
_MARKS = range(1 << len(FILLED))


def _marked_rows(df: DataFrame, fills: PriceFills, own: str) -> DataFrame:
    """Distinct filled rows per mark: filled values, raw values, copies; helpers are named ``own...``.

    The rows of one filled row are numbered from 0.
    """
    columns = df.columns
    bits = [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(FILLED)]
    marked = df.withColumn(f"{own}mark", sum(bits[1:], bits[0]))
    filled = marked.transform(fill_unknown).transform(impute_unit_price, fills)
    counted = filled.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        *[F.count_if(F.col(f"{own}mark") == m).alias(f"{own}n{m}") for m in _MARKS]
    )
    variants = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"{own}n{m}").alias("n")) for m in _MARKS])
    numbered = counted.select(
        *[F.col(f"`{c}`") for c in columns], F.posexplode(F.filter(variants, lambda v: v["n"] > 0)).alias(f"{own}nth", f"{own}variant")
    )
    raw = {
        f"{own}raw_{c}": F.when(F.col(f"{own}variant.mark").bitwiseAND(1 << i) == 0, F.col(c))
        for i, c in enumerate(FILLED)
    }
    return numbered.withColumns(raw | {f"{own}copies": F.col(f"{own}variant.n")}).drop(f"{own}variant")


def _lone_rows(df: DataFrame, fills: PriceFills, own: str) -> DataFrame:
    """The same for rows without a product, whose price is filled even if they have one.

    Raw rows are counted first, a group of copies before its shuffle. So only different raw rows,
    which may differ in the price that is overwritten, are then numbered by filled row.
    """
    columns = df.columns
    copies = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias(f"{own}copies"))
    raw = copies.withColumns({f"{own}raw_{c}": F.col(c) for c in FILLED})
    filled = raw.transform(fill_unknown).transform(impute_unit_price, fills)
    same = Window.partitionBy(*[F.col(f"`{c}`") for c in columns]).orderBy(*[f"{own}raw_{c}" for c in FILLED])
    return filled.withColumn(f"{own}nth", F.row_number().over(same) - 1)


def _single_rows(df: DataFrame, fills: PriceFills, own: str) -> DataFrame:
    """The same for rows of which none has an equal, filled or not: nothing is grouped."""
    raw = df.withColumns(
        {f"{own}nth": F.lit(0), f"{own}copies": F.lit(1).cast("bigint")} | {f"{own}raw_{c}": F.col(c) for c in FILLED}
    )
    return raw.transform(fill_unknown).transform(impute_unit_price, fills)


def _distinct_rows(df: DataFrame, fills: PriceFills, own: str) -> DataFrame:
    """All rows as ``_marked_rows`` has them; the few without a product are read apart.

    Rows equal once filled are equal in the columns that no fill writes to, so rows that have no equal there are
    neither counted nor numbered by whole rows.
    """
    alone, others = split(df, [c for c in df.columns if c not in FILLED])
    marked = _marked_rows(others.where("product_id IS NOT NULL"), fills, own)
    lone = _lone_rows(others.where("product_id IS NULL"), fills, own)
    return _single_rows(alone, fills, own).unionByName(marked).unionByName(lone)


def _swap(df: DataFrame, prefix_in: str, prefix_out: str) -> DataFrame:
    """Rename the filled columns away and another version of them in."""
    away = df.withColumnsRenamed({c: prefix_out + c for c in FILLED})
    return away.withColumnsRenamed({prefix_in + c: c for c in FILLED})


def profile_and_clean(
    df: DataFrame, rules: Mapping[str, Column], path: str, email_mode: str = "literal"
) -> DataFrame:
    """Publish the cleaned orders at ``path``; return the profile of the raw ones.

    The counts are observed in the stage that writes, after the last shuffle, where
    Spark applies each task's update once.
    """
    fills = price_fills(price_counts(df))
    columns = df.columns
    own = free_prefix(columns)
    seen = Observation()
    raw = _swap(_distinct_rows(df, fills, own), f"{own}raw_", f"{own}filled_")
    # Plain columns first: an observed expression is not compiled with the rest of the stage.
    counts = {f"{own}{name}": count for name, count in row_counts(columns, rules, F.col(f"{own}copies")).items()}
    raw = raw.withColumns(counts).observe(
        seen, *[total.alias(name.removeprefix(own)) for name, total in zip(counts, totals(counts))]
    )
    filled = _swap(raw.where(F.col(f"{own}nth") == 0), f"{own}filled_", f"{own}raw_").select([F.col(f"`{c}`") for c in columns])
    publish(filled.transform(drop_null_email).transform(finish, email_mode), path)
    if not seen.get:
        return stage(row_profile(df, rules), "profile_before")
    schema = ", ".join(f"`{name}` bigint" for name in seen.get)
    return df.sparkSession.createDataFrame([tuple(seen.get.values())], schema)
