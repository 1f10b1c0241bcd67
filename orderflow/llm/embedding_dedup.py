"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors are compared only within a label. Each is projected on PROJECTIONS random directions, and
the projections are sorted. For a query vector, the vectors within a window around its own
projection collide with it; pairs that collide on at least LEAST projections are verified by cosine in
double precision. Window and count are calibrated to the similarity: a pair at the very limit
collides on one direction with the chance of a normal difference of that length, and the count is the largest
that such a pair reaches with a chance of 1 - MISS.

A label is cut into blocks along its first direction, so that no task holds a label. As that direction
has length 1, vectors further apart on it than the limit allows can't be similar, and pairs of
such blocks are not compared. A pair of blocks gives each vector its number of links and the
smallest one that links reach, not pairs: a thousand copies of one vector yield a thousand rows.

Vectors that are null, zero, or hold null or non-finite components, and those without label or id,
link with nothing and are their own components. Rows with one vec_id are different vectors of one
name: they are counted as links and share their component. An empty table gives no row. Vectors of different length
don't link. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.components import components
from orderflow.llm.groups import whole_groups
from orderflow.llm.tables import written

PROJECTIONS = 40
MISS = 1e-9
BLOCK_ROWS = 4096
CELLS = 4096
SEED = 31


def directions(size: int, count: int = PROJECTIONS) -> np.ndarray:
    """Random directions; the first has length 1."""
    found = np.random.default_rng(SEED).normal(size=(count, size))
    found[0] /= np.linalg.norm(found[0])
    return found


def calibrated(similarity: float) -> tuple[float, int]:
    """Half the window's width, and the least number of collisions of a pair to be verified."""
    limit = math.sqrt(max(2 - 2 * similarity, 1e-12))
    half = 1.5 * limit
    hit = math.erf(half / limit / math.sqrt(2))
    chance, least = 0.0, 0
    for k in range(PROJECTIONS):  # the chance of k collisions or fewer
        chance += math.comb(PROJECTIONS - 1, k) * hit**k * (1 - hit) ** (PROJECTIONS - 1 - k)
        if chance > MISS:
            break
        least = k + 1
    return half, least


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, size, cell, unit): vectors that can link, scaled to length 1, with their cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            known = pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("label"))).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[known]).tolist():
                at = np.flatnonzero(known & (sizes == size))
                if size == 0:
                    continue
                own = batch.take(pa.array(at))
                v = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # null: NaN
                top = np.abs(v).max(axis=1)
                fine = np.flatnonzero(np.isfinite(v).all(axis=1) & (top > 0))
                v = v[fine] / top[fine, None]
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                cells = np.minimum(CELLS - 1, ((v @ directions(size, 1)[0] + 1) / 2 * CELLS).astype(np.int64))
                own = own.take(pa.array(fine))
                step, raw = 8 * size, v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("row"), own.column("vec_id"), own.column("label"), pa.array(np.full(len(fine), size), pa.int32()),
                        pa.array(cells, pa.int32()), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary()),
                    ],
                    ["row", "vec_id", "label", "size", "cell", "unit"],
                )

    return vectors.mapInArrow(rows, "row bigint, vec_id bigint, label string, size int, cell int, unit binary")


def _blocks(unit: DataFrame) -> DataFrame:
    """(label, size, cell, block, parts): runs of cells of about BLOCK_ROWS rows; a full cell is cut by hash."""
    cells = unit.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("label", "size").orderBy("cell")
    before = F.sum("n").over(own) - F.col("n")
    return cells.select(
        "label", "size", "cell",
        F.floor(before / BLOCK_ROWS).alias("block"),
        F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"),
    )


def block_links(unit: DataFrame, similarity: float) -> DataFrame:
    """(vec_id, row, links, root) for each vector and pair of blocks: links found, smallest id reached."""
    limit = math.sqrt(2 - 2 * similarity)
    reach_cells = math.ceil(limit / 2 * CELLS) + 1
    half, least = calibrated(similarity)
    blocks = written(_blocks(unit), "blocks")
    rows = unit.join(blocks, ["label", "size", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    )
    spans = blocks.groupBy("label", "size", "block").agg(
        F.min("cell").alias("low"), F.max("cell").alias("high"), F.max("parts").alias("parts")
    ).select("label", "size", "block", "low", "high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = spans.select("label", "size", *[F.col(c).alias(f"{c}1") for c in ("block", "low", "high", "part")])
    two = spans.select("label", "size", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high", "part")])
    pairs = one.join(two, ["label", "size"]).where(
        ((F.col("block1") < F.col("block2")) | ((F.col("block1") == F.col("block2")) & (F.col("part1") <= F.col("part2"))))
        & (F.col("low2") - F.col("high1") <= reach_cells)
    ).select("label", "size", "block1", "part1", "block2", "part2")
    pairs = written(pairs.withColumn("pair", F.xxhash64("label", "size", "block1", "part1", "block2", "part2")), "pairs")
    first = pairs.select("label", "size", F.col("block1").alias("block"), F.col("part1").alias("part"), "pair", F.lit(0).alias("side"))
    second = pairs.where("block1 <> block2 OR part1 <> part2").select(
        "label", "size", F.col("block2").alias("block"), F.col("part2").alias("part"), "pair", F.lit(1).alias("side")
    )
    dealt = rows.join(first.unionByName(second), ["label", "size", "block", "part"]).select("pair", "side", "vec_id", "row", "size", "unit")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["pair"]):
            side = group.column("side").to_numpy()
            ids, size = group.column("vec_id").to_numpy(), group.column("size")[0].as_py()
            flat = b"".join(group.column("unit").to_pylist())
            vectors = np.frombuffer(flat, np.float64).reshape(-1, size)
            count, root = collide(vectors, ids, side, similarity, half, least)
            found = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found]), group.column("row").combine_chunks().take(pa.array(found)), pa.array(count[found]), pa.array(root[found])],
                ["vec_id", "row", "links", "root"],
            )

    return (
        dealt.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(links, "vec_id bigint, row bigint, links bigint, root bigint")
    )


def collide(vectors, ids, side, similarity: float, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector and the smallest id reached, within one block or between sides 0 and 1."""
    n = len(vectors)
    across = bool(side.any())
    other = np.flatnonzero(side == 1) if across else np.arange(n)
    asked = np.flatnonzero(side == 0)
    seen = vectors @ directions(vectors.shape[1]).T
    orders = np.argsort(seen[other], axis=0, kind="stable")
    orders_t = np.ascontiguousarray(orders.T).astype(np.int32)
    low = np.zeros((len(asked), PROJECTIONS), np.int64)
    high = np.zeros_like(low)
    for p in range(1, PROJECTIONS):  # direction 0 has dealt out the blocks
        line = seen[other, p][orders[:, p]]
        low[:, p] = np.searchsorted(line, seen[asked, p] - half, side="left")
        high[:, p] = np.searchsorted(line, seen[asked, p] + half, side="right")
    count = np.zeros(n, np.int64)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, i in enumerate(asked):
        windows = [orders_t[p, low[k, p] : high[k, p]] for p in range(1, PROJECTIONS)]
        hits = np.bincount(np.concatenate(windows), minlength=len(other))
        near = other[hits >= least]
        if not across:
            near = near[near > i]
        if len(near) == 0:
            continue
        linked = near[vectors[near] @ vectors[i] >= similarity]
        count[i] += len(linked)
        count[linked] += 1
        a = top(i)
        for j in linked.tolist():
            b = top(j)
            if a != b:
                small, large = (a, b) if ids[a] <= ids[b] else (b, a)
                root[large] = small
                a = small
    return count, np.array([ids[top(i)] for i in range(n)], np.int64)


def near_vectors(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    numbered = written(
        vectors.select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
        ).withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    unit = written(usable(numbered), "units")
    links = written(block_links(unit, similarity), "vector_links")
    counts = links.groupBy("row").agg(F.sum("links").alias("n_links"))
    found = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    return (
        numbered.select("vec_id", "row")
        .join(counts, "row", "left")
        .join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )

