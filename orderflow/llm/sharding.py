"""K-d tree sharding: documents split at weighted medians of their metadata.

A node that weighs more than the target is split along the dimension in which its documents spread widest, relative
to the whole table, at the point that halves its bytes; so on until no leaf is above the target that can be
split. The point is found by histograms that Spark sums: a
few bits of an order-preserving 64-bit key at a time, until the bin that holds the middle weighs
next to nothing or is a single key. Nodes and cuts are tables with a row a node that the documents are joined with, so
the number of leaves is not bounded by the driver. Keys end
in a hash of the doc_id, so documents that are equal in a dimension can be split too.

Given a number of shards instead, the heaviest nodes are split first until there are that many leaves; documents that
are few or very unequal may give fewer.

Law: bytes, shards hold nearly equal bytes. A null text weighs one byte, as an empty one; null
metadata come first in their dimension, a null doc_id hashes like any other value. Repeated rows
stay, and rows with one doc_id and equal metadata go to one shard. An empty table gives no row.
A very long text is one document of that weight and never split. Other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.tables import parts, written

STEP_BITS = 12
KEY_BITS = 60  # 30 of the value, 30 of the hash of the doc_id
TOLERANCE = 1e-4
SLOT_ROWS = 50_000
#: A node's number doubles at each level; this deep no node is split further.
LAST_NODE = 1 << 60


def metadata(docs: DataFrame) -> dict[str, Column]:
    """The dimensions of a document, each from 0 to 1."""
    ordinal = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(float(1 << 32))
    found = {
        "size": F.log2(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + F.lit(1.0)) / 32,
        "place": F.xxhash64(F.col("doc_id").cast("bigint")) / F.lit(float(1 << 64)) + 0.5,
    }
    return {c: ordinal(c) for c in ("lang", "source") if c in docs.columns} | found


def kd_shards(docs: DataFrame, target_bytes: float | None = None, shards: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), by target bytes or by number of shards."""
    if (target_bytes is None) == (shards is None):
        raise ValueError("give either the target bytes or the number of shards")
    dims = metadata(docs)
    names = [f"d{i}" for i in range(len(dims))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[_key(value).alias(name) for name, value in zip(names, dims.values())],
        F.lit(1).cast("bigint").alias("node"),
    )
    placed = written(rows, "metadata")
    root = None
    while True:
        nodes = written(placed.groupBy("node").agg(F.sum("size").alias("total"), *[(F.max(n) - F.min(n)).alias(n) for n in names]), "nodes")
        if root is None:
            root = nodes.first()
            if root is None:
                break
            target_bytes = target_bytes if shards is None else root["total"] / (2 * shards)
        spread = F.array(*[F.col(n) / max(1, root[n]) for n in names])
        dim = (F.array_position(spread, F.array_max(spread)) - 1).cast("int")
        heavy = nodes.where((F.col("total") > target_bytes) & (F.array_max(spread) > 0) & (F.col("node") < LAST_NODE)).select("node", "total", dim.alias("dim"))
        if shards is not None:
            heavy = heavy.orderBy(F.desc("total"), "node").limit(max(0, shards - nodes.count()))
        heavy = written(heavy, "heavy")
        if heavy.isEmpty():
            break
        value = F.get(F.array(*names), F.col("dim"))
        side = F.col("node") * 2 + (value >= F.col("cut")).cast("int")
        placed = written(
            placed.join(_cuts(placed.withColumn("all", F.array(*names)), heavy), "node", "left")
            .withColumn("node", F.coalesce(side, F.col("node"))).drop("dim", "cut"),
            "placed",
        )
    # leaves from left to right: a row a leaf
    left = Window.orderBy(F.expr("node * shiftleft(1L, 61 - CAST(floor(log2(node)) AS INT))"))
    leaves = nodes.select("node", (F.row_number().over(left) - 1).alias("shard"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "node").join(leaves, "node").drop("node"), "shards")
    return _slots(placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def _key(value: Column) -> Column:
    """The value's first 30 bits, then 30 of a hash of the doc_id: order by value, then evenly."""
    half = 1 << (KEY_BITS // 2)
    high = F.least(F.floor(value * half), F.lit(half - 1)).cast("bigint")
    return high * half + F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(7)), F.lit(half))


def _cuts(placed: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, dim, cut): the dimension of each heavy node and the first key of its upper half.

    ``prefix`` holds the leading bits of a node's cut that are known, ``before`` the weight below them.
    """
    start = heavy.select("node", "dim", "total", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    state, cuts, shift = start, [], KEY_BITS
    while shift > 0:
        shift -= STEP_BITS
        value = F.get(F.col("all"), F.col("dim"))
        inside = placed.select("node", "size", "all").join(state, "node").where(F.shiftright(value, shift + STEP_BITS) == F.col("prefix"))
        bins = inside.groupBy("node", "dim", "total", "before", F.shiftright(value, shift).alias("bin")).agg(F.sum("size").alias("w"))
        wanted = F.col("total") / 2 - F.col("before")
        middle = bins.withColumn("below", F.sum("w").over(Window.partitionBy("node").orderBy("bin")) - F.col("w")).where(
            (F.col("below") < wanted) & (F.col("below") + F.col("w") >= wanted)
        )
        found = written(
            middle.select(
                "node", "dim", "total", F.col("bin").alias("prefix"), (F.col("before") + F.col("below")).alias("before"), "w",
                ((F.col("w") <= TOLERANCE * F.col("total")) | F.lit(shift == 0)).alias("settled"),
            ),
            "middles",
        )
        # the cut goes to the nearer edge of the bin
        upper = (F.col("total") / 2 - F.col("before") > F.col("w") / 2).cast("bigint")
        cuts.append(found.where("settled").select("node", "dim", F.shiftleft(F.col("prefix") + upper, shift).alias("cut")))
        state = found.where("NOT settled").drop("w", "settled")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, cuts)


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, bucket by bucket, so that no task holds a shard."""
    count = placed.count()
    buckets = parts(count, SLOT_ROWS)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        rows.withColumn("own", own)
        .join(sizes.select("shard", "bucket", before.alias("base")), ["shard", "bucket"])
        .withColumn("slot", (F.col("base") + F.col("own")).cast("bigint"))
    )
