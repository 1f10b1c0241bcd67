"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

A unit vector is turned by pseudo-rotations, random signs and a fast Hadamard transform three times
over, and falls to the signed axis it lies nearest to; ``digits`` such axes are a bucket of a table.
There are TABLES tables. A query looks into the buckets it lies next to in each (multiprobe): axes
in the order of its own components. All vectors of these buckets are measured on the original
vectors, in double precision.

How many buckets a query probes is calibrated: on a bounded sample (SAMPLE_ROWS rows, drawn by hash,
SAMPLE_QUERIES of them asked), the least number that finds RECALL of the true neighbours. Neighbours in a sample lie
further off than in the whole table, so that number errs on the safe side. Every row is indexed.

Equal vectors are one class: a class is hashed and measured once, and its ``k + 1`` smallest ids are
all that can appear in a result, so many copies of one vector cost nothing. A bucket is dealt out to
tasks in blocks of BLOCK_ROWS classes; queries stream past a block, so no task holds a bucket or all of its
queries. Queries that found fewer rows than there are to be found are asked against all classes, block by block.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different length are never compared. Rows that repeat a vec_id are vectors of their own, a query that
is on several rows is answered for each. Ties go to the smaller vec_id, then the earlier row; rows
without a vec_id can't be found or asked. An empty table gives no row. Squares beyond a
double make a distance infinite. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.tables import written

TABLES = 4
BLOCK_ROWS = 4096
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 256
RECALL = 0.97
SEED = 12


def padded(size: int) -> int:
    return 1 << max(1, (size - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in place; the number of columns is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        both = pairs[:, :, 0] + pairs[:, :, 1]
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=pairs[:, :, 1])
        pairs[:, :, 0] = both
        step *= 2
    return x


def rotations(unit: np.ndarray, table: int, digits: int) -> list[np.ndarray]:
    """The unit vectors turned by each pseudo-rotation of a table."""
    wide = padded(unit.shape[1])
    found = []
    for digit in range(digits):
        signs = np.random.default_rng([SEED, table, digit, wide]).choice([-1.0, 1.0], (3, wide))
        x = np.zeros((len(unit), wide))
        x[:, : unit.shape[1]] = unit
        for s in signs:
            x = hadamard(x * s)
        found.append(x / wide**1.5)
    return found


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bucket_of(unit: np.ndarray, table: int, digits: int) -> np.ndarray:
    """The bucket of each vector: its nearest signed axis, digit by digit."""
    bucket = np.zeros(len(unit), np.int64)
    for x in rotations(unit, table, digits):
        axis = np.abs(x).argmax(axis=1)
        bucket = bucket * 2 * x.shape[1] + 2 * axis + (x[np.arange(len(x)), axis] < 0)
    return bucket


def probes_of(unit: np.ndarray, table: int, digits: int, probes: int) -> np.ndarray:
    """The ``probes`` buckets that each vector lies next to, nearest first."""
    bucket = cost = None
    for x in rotations(unit, table, digits):
        signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
        gap = np.square(np.abs(x).max(axis=1, keepdims=True) - signed)
        order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        gap = np.take_along_axis(gap, order, axis=1)
        if bucket is None:
            bucket, cost = order.astype(np.int64), gap
            continue
        bucket = (bucket[:, :, None] * signed.shape[1] + order[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        bucket, cost = np.take_along_axis(bucket, best, axis=1), np.take_along_axis(cost, best, axis=1)
    return bucket


def nearest(index: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` rows nearest to each query; ties by ``ids``."""
    if not len(index) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = np.einsum("ij,ij->i", index, index), np.einsum("ij,ij->i", asked, asked)
        rough = other[:, None] + own[None] - 2 * (asked @ index.T)
        rough[np.isnan(rough)] = 0  # infinite squares: measured below
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(index) else np.full(len(asked), np.inf)
        margin = 1e-11 * (other + own.max())
        query, row = np.nonzero(rough <= (edge + margin)[:, None])
        apart = np.sqrt(np.square(asked[query] - index[row]).sum(axis=1))
    order = np.lexsort((ids[row], apart, query))
    query, row, apart = query[order], row[order], apart[order]
    first = np.searchsorted(query, np.arange(len(asked)))
    keep = np.arange(len(query)) - first[query] < k
    return query[keep], row[keep], apart[keep]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, kept as bytes, as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, size, vector): the rows that take part."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector"))
        .withColumn("row", F.monotonically_increasing_id())
        .where("vec_id IS NOT NULL AND vector IS NOT NULL").where(fine)
        .select("row", "vec_id", F.size("vector").alias("size"), "vector")
    )


def _as_bytes(df: DataFrame) -> DataFrame:
    """``vector`` as the bytes of its doubles."""
    names = [c for c in df.columns if c != "vector"]
    kept = T.StructType([f for f in df.schema if f.name != "vector"]).add("vector", "binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy().tobytes()
            ends = 8 * np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            packed = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(packed, pa.binary())], [*names, "vector"])

    return df.select(*names, "vector").mapInArrow(rows, kept)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(class, first_id, size, members, vector): equal vectors once, with the ``k + 1`` smallest ids that have it."""
    own = Window.partitionBy("size", "vector").orderBy("vec_id", "row")
    least = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1)
    member = F.struct("vec_id", "row")
    found = least.groupBy("size", "vector").agg(F.min(member).alias("first"), F.array_sort(F.collect_list(member)).alias("members"))
    return found.select(F.col("first.row").alias("class"), F.col("first.vec_id").alias("first_id"), "size", "members", "vector")


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the rows of each length."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, matrix(batch.column("vector").take(pa.array(at)))


def hashed(df: DataFrame, digits: int, probes: int | None) -> DataFrame:
    """(bucket, class, first_id, size, vector): a row for each table, or with ``probes`` for each bucket probed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                for at, vectors in _grouped(batch):
                    unit = units(vectors)
                    for table in range(TABLES):
                        many = bucket_of(unit, table, digits)[:, None] if probes is None else probes_of(unit, table, digits, probes)
                        for first in range(0, many.shape[1], 32):
                            some = many[:, first : first + 32]
                            places = pa.array(np.repeat(at, some.shape[1]))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(some.ravel() * TABLES + table), *[batch.column(c).take(places) for c in ("class", "first_id", "size", "vector")]],
                                ["bucket", "class", "first_id", "size", "vector"],
                            )

    return df.select("class", "first_id", "size", "vector").mapInArrow(rows, "bucket bigint, class bigint, first_id bigint, size int, vector binary")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("class"), blocks).cast("int")


def _in_blocks(index: DataFrame, asked: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block of their bucket: a row of the index lies in one, a query meets all."""
    key = ["size", "bucket"]
    blocks = counts.select(*key, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    blocks = written(blocks, "full_buckets")
    many = F.coalesce("blocks", F.lit(1))
    dealt = index.join(blocks, key, "left").withColumn("block", _block(many)).drop("blocks")
    all_blocks = asked.join(blocks, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), many - 1))).drop("blocks")
    return dealt, all_blocks


def measured(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, class, first_id, score): the ``k`` classes of each block that are nearest to each query."""
    columns = ["size", "bucket", "block", "side", "class", "first_id", "vector"]
    both = index.withColumn("side", F.lit(0)).select(*columns).unionByName(asked.withColumn("side", F.lit(1)).select(*columns))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        block = None
        for whole in batches:
            keys = [whole.column(c).to_numpy() for c in ("size", "bucket", "block", "side")]
            change = np.zeros(whole.num_rows, dtype=bool)
            change[:1] = True
            for values in keys:
                change[1:] |= values[1:] != values[:-1]
            cuts = [*np.flatnonzero(change).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now, side = tuple(values[a] for values in keys[:3]), keys[3][a]
                if now != key:
                    key, held, block = now, [], None
                part = whole.slice(a, b - a)
                if side == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    block = matrix(table.column("vector")), table.column("class").to_numpy(), table.column("first_id").to_numpy()
                vectors, names, ids = block
                for start in range(0, part.num_rows, 256):
                    some = part.slice(start, 256)
                    query, row, apart = nearest(vectors, ids, matrix(some.column("vector")), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some.column("class").to_numpy()[query]), pa.array(names[row]), pa.array(ids[row]), pa.array(apart)],
                        ["query", "class", "first_id", "score"],
                    )

    return (
        both.repartition("size", "bucket", "block").sortWithinPartitions("size", "bucket", "block", "side")
        .mapInArrow(rows, "query bigint, class bigint, first_id bigint, score double")
    )


def _answers(found: DataFrame, index: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(row, query_id, rank, vec_id, score): the nearest rows of each asking row, its own left out."""
    by_query = Window.partitionBy("query").orderBy("score", "first_id", "class")
    best = (
        found.repartition("query").dropDuplicates(["query", "class"])
        .withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k + 1).drop("place", "first_id")
    )
    members = index.select("class", F.explode("members").alias("member")).select("class", "member.*")
    rows = best.join(members.select("class", "vec_id", F.col("row").alias("found_row")), "class")
    ranked = Window.partitionBy("row").orderBy("score", "vec_id", "found_row")
    return (
        asking.select("row", F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
        .join(rows, "query").where("row <> found_row")
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("row", "query_id", "rank", "vec_id", "score")
    )


def calibrated(index: DataFrame, size: int, digits: int, k: int) -> int:
    """The least number of probes a table that finds RECALL of the neighbours within a bounded sample."""
    sample = index.where(F.col("size") == size).orderBy(F.xxhash64(F.col("class")), "class").select("vector").limit(SAMPLE_ROWS).toArrow()
    vectors = matrix(sample.column("vector").combine_chunks())
    asked = vectors[:SAMPLE_QUERIES]
    k = min(k, len(vectors) - 1)
    if k < 1:
        return 1
    query, row, _ = nearest(vectors, np.arange(len(vectors)), asked, k + 1)
    query, row = query[query != row], row[query != row]
    unit, of = units(vectors), units(asked)
    most = min(4096, (2 * padded(size)) ** digits)
    first = np.full(len(query), most)  # the number of probes that reaches each neighbour
    for table in range(TABLES):
        own = bucket_of(unit, table, digits)[row]
        hit = probes_of(of, table, digits, most)[query] == own[:, None]
        first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    return int(min(most, np.sort(first)[math.ceil(RECALL * len(first)) - 1] + 1))


def neighbours(vectors: DataFrame, asks: Column, k: int = 10, digits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows nearest to each row for which ``asks`` holds.

    ``asks`` is a condition on vec_id. ``digits`` is the number of axes of a bucket; by default as many
    as it takes for buckets of a block's size, were vectors spread evenly.
    """
    rows = written(usable(vectors), "usable_vectors")
    index = written(_as_bytes(classes(rows, k)), "vector_classes")
    asking = _as_bytes(rows.where(asks))
    asking = written(asking.join(index.select("class", "vector", "size"), ["size", "vector"]).select("row", "vec_id", "size", "class"), "asking")
    sizes = index.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).alias("rows")).orderBy(F.desc("n"), "size")
    common = sizes.first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    axes = 2 * padded(common["size"])
    if digits is None:
        digits = max(1, math.ceil(math.log(common["n"] / BLOCK_ROWS, axes))) if common["n"] > BLOCK_ROWS else 1
    probes = calibrated(index, common["size"], digits, k)
    queries = index.join(asking.select("class").distinct(), "class", "left_semi")
    keyed = written(hashed(index, digits, None), "hashed_index")
    counts = keyed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    found = measured(*_in_blocks(keyed, hashed(queries, digits, probes), counts), k + 1)
    answers = written(_answers(found, index, asking, k), "answers")
    # what is left: queries with fewer rows than there are to be found
    had = answers.groupBy("row").agg(F.count(F.lit(1)).alias("had"))
    lacking = (
        asking.join(sizes, "size").join(had, "row", "left")
        .where(F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1)).select("row", "vec_id", "size", "class")
    )
    lacking = written(lacking, "lacking")
    one = F.lit(0).cast("bigint").alias("bucket")
    left = index.join(lacking.select("class").distinct(), "class", "left_semi")
    kept = index.join(left.select("size").distinct(), "size", "left_semi")
    rest = measured(
        *_in_blocks(kept.select("*", one), left.select("*", one), kept.groupBy("size", one).agg(F.count(F.lit(1)).alias("n"))), k + 1
    )
    whole = answers.join(lacking.select("row"), "row", "left_anti").unionByName(_answers(rest, index, lacking, k))
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
