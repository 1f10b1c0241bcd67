"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents are shuffled by a seeded hash and laid end to end; the stream is cut into
blocks of equally many words. Slot i of the mix has the point frac(i / golden ratio), exact in
64-bit integers, and goes to the source in whose share of the cumulative weights it falls.
The k-th slot of a source takes its block k modulo their number: a source that is wanted more than
once is repeated from its start. Points are spread so evenly that each source has its share of every
stretch of the mix, up to a few blocks. Slots beyond two rounds of a source stay empty.

Sizes are words; a null or empty text has none and is never taken. Null sources form a source of their
own, the last. Rows with one doc_id are dealt one by one; a null doc_id is shuffled like any other
value. An empty table, or one without words, gives an empty mix. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.tables import fresh, parts, written
from orderflow.llm.words import chunks, texts_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
STREAM_ROWS = 20_000
SCHEDULE_SLOTS = 1 << 16

#: 2^64 divided by the golden ratio, as an odd number.
GOLDEN = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, *others: str) -> DataFrame:
    """``others`` and the words of each text as ``size``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                sizes = np.diff(words_of(texts_of(chunk.column("text"))).first)
                yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in others], pa.array(sizes, pa.int64())], [*others, "size"])

    kept = docs.select(*others, F.col("text").cast("string"))
    return kept.mapInArrow(rows, kept.drop("text").withColumn("size", F.lit(0).cast("bigint")).schema)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rank, source_size, target): weighted shares of all words, none above ``most`` sizes.

    What the limit takes from a source goes to the others by weight. With sources in the order in
    which they reach their limit, the common level per unit of weight has a closed form. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * float(most))
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    # the level if this source and all after it stay below their limits: the last that is too high tells
    levels = sources.withColumn("level", left / open_weight)
    held = levels.withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight")))
    return held.withColumn("target", target).select("source", "rank", "source_size", "target")


def streams(sizes: DataFrame, seed: int) -> DataFrame:
    """Where each document of a source begins in its shuffled stream of words, as ``at``."""
    rows = written(
        sizes.where("size > 0").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes"
    )
    buckets = 1 << (parts(rows.count(), STREAM_ROWS) - 1).bit_length()
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("n")
    inside = F.sum("size").over(
        Window.partitionBy("rank", "bucket").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    return (
        rows.withColumn("own", inside)
        .join(totals.select("rank", "bucket", before.alias("base")), ["rank", "bucket"])
        .select("rank", "row", "doc_id", "size", (F.col("base") + F.col("own")).alias("at"))
    )


def schedule(spark, shares: list[tuple[int, int, float]], slots: int) -> DataFrame:
    """(slot, rank, blocks, turn): the source of each slot, its blocks, and its slots before this one.

    ``shares`` has a source's rank, number of blocks and weight.
    """
    ranks = np.array([r for r, _, _ in shares], np.int64)
    blocks = np.array([b for _, b, _ in shares], np.int64)
    edges = np.cumsum([s for _, _, s in shares])
    edges = edges / edges[-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("id").to_numpy()
            point = (slot.astype(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(11)
            source = np.minimum(np.searchsorted(edges, point / float(1 << 53), side="right"), len(ranks) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // SCHEDULE_SLOTS), pa.array(ranks[source]), pa.array(blocks[source])],
                ["slot", "stretch", "rank", "blocks"],
            )

    dealt = spark.range(0, slots, 1, parts(slots, 16 * SCHEDULE_SLOTS)).mapInArrow(rows, "slot bigint, stretch bigint, rank bigint, blocks bigint")
    counts = dealt.groupBy("rank", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("rank").orderBy("stretch")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("slot")) - 1
    return dealt.withColumn("own", own).join(
        counts.select("rank", "stretch", before.alias("base")), ["rank", "stretch"]
    ).select("slot", "rank", "blocks", (F.col("base") + F.col("own")).alias("turn"))


def mix_pieces(sizes: DataFrame, wanted: DataFrame, seed: int = 11, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix: for each slot the pieces of documents in its block, as words [first, first + words).

    ``sizes`` has (row, doc_id, rank, size), ``wanted`` the targets.
    """
    spark = sizes.sparkSession
    # a source's weight in the schedule is its target in blocks; the last block of a round is shorter
    plan = wanted.where("source_size > 0").select(
        "rank",
        F.ceil(F.col("source_size") / block).alias("blocks"),
        (F.col("target") / F.col("source_size") * F.ceil(F.col("source_size") / block)).alias("share"),
    )
    shares = [(r["rank"], r["blocks"], r["share"]) for r in plan.orderBy("rank").collect()]  # one row a source
    slots = round(sum(s for _, _, s in shares))
    if not slots:
        return spark.createDataFrame([], "slot bigint, round bigint, row bigint, doc_id bigint, first bigint, words bigint")
    turns = (
        schedule(spark, shares, slots)
        .where(F.col("turn") < MOST * F.col("blocks"))
        .select("slot", "rank", (F.col("turn") % F.col("blocks")).alias("block"), F.floor(F.col("turn") / F.col("blocks")).alias("round"))
    )
    laid = streams(sizes, seed)
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    held = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    low = F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = held.select("rank", "block", "row", "doc_id", (low - F.col("at")).alias("first"), (high - low).alias("words"))
    return turns.join(pieces, ["rank", "block"]).select("slot", "round", "row", "doc_id", "first", "words")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, source, rank, size) written once, and the targets."""
    named = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"
    )
    sizes = written(word_counts(named, "doc_id", "source").withColumn("row", F.monotonically_increasing_id()), "words")
    wanted = written(targets(sizes), "targets")
    ranked = sizes.join(wanted.select(F.col("source").alias("name"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return ranked, wanted


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes."""
    ranked, wanted = _numbered(docs)
    taken = mix_pieces(ranked.select("row", "doc_id", "rank", "size"), wanted).groupBy("row").agg(F.sum("words").alias("taken"))
    return ranked.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with all their columns: once for each round, cut to
    the words taken in that round. Words and the white space between them stay as they are."""
    row, first, words, pieces = fresh(docs, "mix_row", "mix_first", "mix_words", "mix_pieces")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    named = numbered.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.col(row).alias("row"))
    sizes = written(word_counts(named, "doc_id", "source", "row"), "words")
    wanted = written(targets(sizes), "targets")
    ranked = sizes.join(wanted.select(F.col("source").alias("name"), "rank"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # blocks of a round are taken in order, so what a round takes of a document is one run of words
    runs = mix_pieces(ranked.select("row", "doc_id", "rank", "size"), wanted).groupBy("row", "round").agg(
        F.min("first").alias(first), F.sum("words").alias(words)
    )
    copies = runs.select(F.col("row").alias(row), first, words)
    joined = numbered.hint("merge").join(copies, row).drop(row)

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                texts = texts_of(chunk.column("text"))
                found = words_of(texts)
                raw = texts.data.tobytes()
                taken = []
                for i, (a, n) in enumerate(zip(chunk.column(first).to_pylist(), chunk.column(words).to_pylist())):
                    opens, total = found.first[i], found.first[i + 1] - found.first[i]
                    low = texts.offsets[i] if a == 0 else found.start[opens + a]
                    high = texts.offsets[i + 1] if a + n == total else found.end[opens + a + n - 1]
                    taken.append(raw[low:high].decode())
                at = chunk.schema.get_field_index("text")
                yield chunk.set_column(at, chunk.schema.field(at), pa.array(taken, chunk.schema.field(at).type)).select(names)

    return joined.select(*names, first, words).mapInArrow(cut, docs.schema)
