"""What may occur more than once, told by a filter of bounded size.

Finding equal rows takes a shuffle of whole rows, but only of those that have an equal. Here rows are
counted by a hash of their cells first, which moves a few bytes a row. A row whose hash occurs once has
no equal for sure; all others, those that merely share a hash included, are left to the caller to
compare cell by cell, so no result hangs on the hash.

The hashes wanted are kept as bits of words, 64 words to a row, so a filter takes little more room than its bits.
Their number is fixed: the fuller the filter, the more rows pass that need not; none that has to pass is held back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.operators.names import free_prefix
from orderflow.sources.shared_folder import stage

#: Bits of a filter, which every task gets: at most 2^23 words of 64 bits, 64 MB.
FILTER_BITS = 1 << 29

_BLOCK = 64


def _word(key: Column) -> Column:
    return F.shiftright(F.pmod(key, F.lit(FILTER_BITS)), 6)


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(key, F.lit(64)).cast("int"))


def _block(word: Column) -> Column:
    return F.shiftright(word, 6)


def _slot(word: Column) -> Column:
    return F.pmod(word, F.lit(_BLOCK)).cast("int")


def _filter(keys: DataFrame) -> DataFrame:
    """(_block, _words) of the hashes in the only column of ``keys``; a word without a hash is 0."""
    key, word = F.col(keys.columns[0]), F.col("_word")
    words = keys.groupBy(_word(key).alias("_word")).agg(F.bit_or(_bit(key)).alias("_bits"))
    held = words.groupBy(_block(word).alias("_block")).agg(
        F.map_from_entries(F.collect_list(F.struct(_slot(word), "_bits"))).alias("_held")
    )
    slots = F.sequence(F.lit(0), F.lit(_BLOCK - 1))
    bits = F.transform(slots, lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0).cast("bigint")))
    return stage(held.select("_block", bits.alias("_words")), "filter")


def _marked(df: DataFrame, key: Column, blocks: DataFrame, own: str) -> DataFrame:
    """``df`` with a boolean ``{own}hit``: whether the filter holds the hash of a row."""
    held = blocks.select(F.col("_block").alias(f"{own}block"), F.col("_words").alias(f"{own}words"))
    places = {f"{own}block": _block(_word(key)), f"{own}slot": _slot(_word(key)), f"{own}bit": _bit(key)}
    joined = df.withColumns(places).join(F.broadcast(held), f"{own}block", "left")
    bits = F.get(F.col(f"{own}words"), F.col(f"{own}slot"))
    hit = F.coalesce(bits.bitwiseAND(F.col(f"{own}bit")) != 0, F.lit(False))
    return joined.withColumn(f"{own}hit", hit).drop(*places, f"{own}words")


def split(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that surely have no equal in ``columns`` (all, if not given), and the others.

    ``df`` is read three times, so it should be a written table or a short way from one.
    """
    names = df.columns if columns is None else list(columns)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    own = free_prefix(df.columns)
    counted = df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    marked = _marked(df, key, _filter(counted.where("_n > 1").select("_key")), own)
    hit = F.col(f"{own}hit")
    return marked.where(~hit).drop(f"{own}hit"), marked.where(hit).drop(f"{own}hit")


def among(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is in that of ``wanted``, and maybe a few others."""
    key, own = F.xxhash64(F.col(f"`{column}`")), free_prefix(df.columns)
    marked = _marked(df, key, _filter(wanted.select(key.alias("_key"))), own)
    return marked.where(f"{own}hit").drop(f"{own}hit")
