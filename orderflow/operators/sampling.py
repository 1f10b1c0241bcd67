"""Sampling rows by a deterministic draw from integer key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from orderflow.functions.draws import MODULUS, draw, hits

# A draw has 31 bits, a row's hash 64; a digit is 16 of them.
_DIGIT_BITS = 16
_DIGIT = (1 << _DIGIT_BITS) - 1
_FEW_ROWS = 100_000
_EMIT_ROWS = 100_000


def _key(key_columns: Sequence[str]) -> Column:
    """Integer columns weighted into one non-negative key; null counts as 0."""
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(key_columns):
        value = F.abs(F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
        key = key + value % MODULUS * (1 + 131071 * i)
    return key


def sample_fraction(
    df: DataFrame, key_columns: Sequence[str], fraction: float, seed: int = 1
) -> DataFrame:
    """About ``fraction`` of the rows, decided per row without a shuffle."""
    return df.where(hits(_key(key_columns), 100 + seed, fraction))


def sample_rows(df: DataFrame, key_columns: Sequence[str], n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (all rows if there are fewer): those with the lowest draws.

    Rows with the same draw are taken in the order of a hash of all columns. Every range of places that
    fits as a whole is taken by a filter; the range that the sample ends in is cut finer, digit by
    digit, until it has few rows. Copies of a row share every digit, so they are counted at the end.
    """
    place = draw(_key(key_columns), 100 + seed)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    digits = [
        F.shiftright(place, _DIGIT_BITS),
        place.bitwiseAND(_DIGIT),
        F.shiftrightunsigned(tie, 48),
        F.shiftrightunsigned(tie, 32).bitwiseAND(_DIGIT),
    ]
    taken, here, wanted = F.lit(False), F.lit(True), n
    for digit in digits:
        cut = _first_above(df.where(here).groupBy(digit.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")), wanted)
        if cut is None:
            return df.where(taken | here)
        taken = taken | (here & (digit < cut.bucket))
        here, wanted = here & (digit == cut.bucket), wanted - cut.before
        if wanted == 0:
            return df.where(taken)
        if cut.rows <= _FEW_ROWS:
            break
    return df.where(taken).unionByName(_cut_rows(df.where(here), wanted, place, tie))


def _cut_rows(df: DataFrame, wanted: int, place: Column, tie: Column) -> DataFrame:
    """The first ``wanted`` rows by place, hash and columns, of rows few but for their copies."""
    own = "_of_"
    while any(c.lower().startswith(own) for c in df.columns):
        own = f"_{own}"
    columns = [F.col(f"`{c}`") for c in df.columns]
    copies, take, block, row = (f"{own}{name}" for name in ("copies", "take", "block", "row"))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(copies))
    upto = Window.orderBy(place, tie, *columns).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(copies).over(upto) - F.col(copies)
    return (
        counted.withColumn(take, F.least(F.col(copies), F.lit(wanted) - before))
        .where(F.col(take) > 0)
        .withColumn(block, F.explode(F.expr(f"sequence(0, ({take} - 1) div {_EMIT_ROWS})")))
        .withColumn(row, F.explode(F.expr(f"sequence(1, least({_EMIT_ROWS}, {take} - {block} * {_EMIT_ROWS}))")))
        .select(columns)
    )


def _first_above(counts: DataFrame, n: int) -> Row | None:
    """The first bucket that takes the running count above n; there are at most 2^16."""
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
    return running.where(F.col("before") + F.col("rows") > n).orderBy("bucket").first()
