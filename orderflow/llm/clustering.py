"""Centroid clustering that skips distances by geometric drift bounds, with exact results.

Vectors are whole numbers, floor(scale * x) of each component, and so are the centroids: floor(sum/count).
Each vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of
the distance to every centroid. When the centroids have moved, the upper bound grows by the way of its own.
A lower bound shrinks by the most that the centroid can have come nearer to any point of the
cluster's sphere (its old centroid, its largest upper bound). In the plane of that sphere's centre
and the way from the old to the new centroid, points that come nearer by more than
``way * cos(angle)`` lie within the wedge of that angle around the way's direction, opened at its
middle: a hyperbola lies between its asymptotes. So a sphere seen from that middle under an angle
to the way comes nearer by at most ``way * cos(angle - half its width)``, which is less than the way
unless the sphere holds the middle or lies ahead. The distance between two centroids less the upper bound is a lower bound too.
Vectors with a lower bound that is not above their upper one are ambiguous: they are measured against their own
centroid, and against each other one whose bound still is no larger, in whole numbers. Ties go to the smaller number.

Every round is one pass without a shuffle: it writes the vectors with their new bounds, and beside
them a few rows a task with sums, counts and radii of the clusters, which are added up exactly.

Kept are vectors of exactly ``size`` components, none null or non-finite, and none so large (2^62 after
scaling) that it is no long. Null and shorter or longer vectors give no row. Rows that repeat a
vec_id are vectors of their own; a vec_id that is null comes last among the first centroids. Equal
vectors go to the same cluster. With fewer vectors than clusters there are as many clusters as
vectors, an empty table gives no row. A distance or inertia beyond a long is given as the largest long.
Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.tables import written

LARGEST = (1 << 63) - 1
#: Bounds are kept this much wider than computed, above the rounding of the floats they are kept as.
SLACK = 1e-6
#: Rows that a task measures at once.
ROWS = 8192

STATE = (
    "vec_id bigint, v array<bigint>, cluster int, upper double, lower array<float>, distance bigint, "
    "n bigint, measured bigint, radius double, inertia decimal(38,0), sums array<decimal(38,0)>"
)
_WHOLE = pa.decimal128(38, 0)


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    fine = (F.size("embedding") == size) & F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 62)))
    return vectors.where("embedding IS NOT NULL").where(fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x).cast("bigint")).alias("v")
    )


def first_centroids(whole: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose seeded ids have the smallest SHA-256."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = whole.select("v", draw.alias("draw")).orderBy(F.asc_nulls_last("draw"), "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def _largest(*arrays: np.ndarray) -> float:
    return max((max(-float(a.min()), float(a.max())) for a in arrays if a.size), default=0.0)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector from one centroid, or from the centroid of its row."""
    largest = 4 * _largest(v, centroids) ** 2 * max(1, v.shape[1])
    if largest < 1 << 53 and centroids.ndim == 1:  # doubles are exact so far
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return np.einsum("ij,ij->i", x, x) - 2 * (x @ c) + c @ c
    apart = v.astype(object) - centroids.astype(object) if largest >= 1 << 62 else v - centroids
    return (apart * apart).sum(axis=1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def drift(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer centroid ``j`` can have come to any point of sphere ``i``: 0 to the way of ``j``."""
    before, after = old.astype(object), new.astype(object)
    ways = (after - before).astype(np.float64)
    way = np.linalg.norm(ways, axis=1)
    found = np.zeros((len(old), len(old)))
    for j in np.flatnonzero(way > 0):
        seen = (2 * before - before[j] - after[j]).astype(np.float64) / 2  # from the middle of the way
        far = np.linalg.norm(seen, axis=1)
        inside = far <= radius * (1 + SLACK)
        safe = np.where(inside, 1, far)
        angle = np.arccos(np.clip(seen @ ways[j] / way[j] / safe, -1, 1)) - np.arcsin(np.where(inside, 0, radius / safe))
        nearer = way[j] * (np.cos(np.clip(angle, 0, np.pi / 2)) + SLACK)
        found[:, j] = np.where(inside, way[j], np.minimum(way[j], nearer))
    return found


class Bounds:
    """What a round knows of all clusters: old and new centroids and how much bounds loosen."""

    def __init__(self, old: np.ndarray | None, new: np.ndarray, radius: np.ndarray | None) -> None:
        self.new, self.first = new, old is None
        if old is None or len(new) == 0:
            return
        self.way = np.linalg.norm((new.astype(object) - old.astype(object)).astype(np.float64), axis=1)
        self.loosen = drift(old, new, radius)
        self.apart = np.stack([_roots(squared(new, c)) for c in new]) * (1 - SLACK)

    def start(self, v: np.ndarray):
        """(cluster, upper, lower, distances measured) by all distances."""
        every = np.stack([squared(v, c) for c in self.new], axis=1)
        own = every.argmin(axis=1).astype(np.int32)
        lower = _roots(every) * (1 - SLACK)
        return own, _roots(every[np.arange(len(v)), own]) * (1 + SLACK), lower, every.size

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, upper, lower, distances measured) after the centroids' move."""
        at = np.arange(len(v))
        upper = (upper + self.way[own]) * (1 + SLACK)
        lower = (lower - self.loosen[own]) * (1 - SLACK)
        beyond = np.maximum(lower, self.apart[own] - upper[:, None])
        beyond[at, own] = np.inf
        doubt = np.flatnonzero((beyond <= upper[:, None]).any(axis=1))
        if not len(doubt):
            return own, upper, lower, 0
        v, was, at = v[doubt], own[doubt], np.arange(len(doubt))
        least, now = squared(v, self.new[was]), was.copy()
        upper[doubt] = _roots(least) * (1 + SLACK)
        lower[doubt, was] = _roots(least) * (1 - SLACK)
        beyond = np.maximum(lower[doubt], self.apart[was] - upper[doubt][:, None])
        beyond[at, was] = np.inf
        measured = len(doubt)
        for c in range(len(self.new)):
            rows = np.flatnonzero(beyond[:, c] <= upper[doubt])
            if not len(rows):
                continue
            measured += len(rows)
            squares = squared(v[rows], self.new[c])
            lower[doubt[rows], c] = _roots(squares) * (1 - SLACK)
            better = (squares < least[rows]) | ((squares == least[rows]) & (c < now[rows]))
            rows = rows[better]
            least[rows], now[rows] = squares[better], c
        upper[doubt] = _roots(least) * (1 + SLACK)
        own = own.copy()
        own[doubt] = now
        return own, upper, lower, measured


def _decimals(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], _WHOLE)


def moved(state: DataFrame, bounds: Bounds, size: int, last: bool) -> DataFrame:
    """The vectors with the clusters and bounds of the new centroids, and each task's sums."""
    clusters = len(bounds.new)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, measured, radius = np.zeros(clusters, np.int64), 0, np.zeros(clusters)
        inertia, sums = [0] * clusters, np.zeros((clusters, size), dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                m = batch.num_rows
                v = batch.column("v").flatten().to_numpy().reshape(m, size)
                if bounds.first:
                    own, upper, lower, asked = bounds.start(v)
                else:
                    lower = batch.column("lower").flatten().to_numpy().reshape(m, clusters).astype(np.float64)
                    own, upper, lower, asked = bounds.assign(v, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), lower)
                measured += asked
                distance = squared(v, bounds.new[own]) if last else None  # whole numbers, row by row
                n += np.bincount(own, minlength=clusters)
                np.maximum.at(radius, own, upper)
                for c in np.unique(own):
                    members = v[own == c]
                    sums[c] += members.astype(object if _largest(members) >= 1 << 48 else np.int64).sum(axis=0).astype(object)
                    if last:
                        inertia[c] += sum(distance[own == c].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper),
                        pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * clusters, pa.array(lower.astype(np.float32).ravel())),
                        pa.nulls(m, pa.int64()) if distance is None else pa.array(np.minimum(distance, LARGEST).astype(np.int64)),
                        *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), _WHOLE, pa.list_(_WHOLE))],
                    ],
                    _NAMES,
                )
        held = np.flatnonzero(n)
        k = len(held)
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(k, t) for t in (pa.int64(), pa.list_(pa.int64()))], pa.array(held, pa.int32()),
                *[pa.nulls(k, t) for t in (pa.float64(), pa.list_(pa.float32()), pa.int64())], pa.array(n[held]),
                pa.array([measured if i == 0 else 0 for i in range(k)], pa.int64()), pa.array(radius[held]),
                _decimals(inertia[c] for c in held), pa.array([[Decimal(int(x)) for x in sums[c]] for c in held], pa.list_(_WHOLE)),
            ],
            _NAMES,
        )

    return state.mapInArrow(rows, STATE)


_NAMES = [field.split()[0] for field in STATE.split(", ")]


def tallies(state: DataFrame, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, int]:
    """(count, radius, inertia, sums, measured) of the clusters, added up over all tasks."""
    parts = state.where("n IS NOT NULL")
    n, radius, inertia, measured = np.zeros(clusters, np.int64), np.zeros(clusters), [0] * clusters, 0
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), F.sum("measured").alias("measured"))
    for r in whole.collect():
        n[r.cluster], radius[r.cluster], inertia[r.cluster] = r.n, r.radius, int(r.inertia or 0)
        measured += r.measured
    sums = np.zeros((clusters, size), dtype=object)
    by_place = parts.select("cluster", F.posexplode("sums").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"))
    for r in by_place.collect():
        sums[r.cluster, r.place] = int(r.x)
    return n, radius, inertia, sums, measured


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured_share) for each kept vector.

    ``measured_share`` is the share of all distances to centroids that the last assignment measured.
    """
    spark = vectors.sparkSession
    state = written(whole_vectors(vectors, size, scale), "whole_vectors")
    centroids = first_centroids(state, clusters, seed)
    clusters = len(centroids)
    old = radius = None
    for k in range(rounds + 1):
        state = written(moved(state, Bounds(old, centroids, radius), size, last=k == rounds), f"assigned_{k}")
        n, radius, inertia, sums, measured = tallies(state, clusters, size)
        state = state.where("n IS NULL")
        if k < rounds:
            old, centroids = centroids, np.array([sums[c] // int(n[c]) if n[c] else centroids[c] for c in range(clusters)]).astype(np.int64)
    total = int(n.sum())
    known = spark.createDataFrame(
        [(c, min(inertia[c], LARGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in range(clusters)],
        "cluster int, cluster_inertia bigint, centroid_sha256 string",
    )
    return state.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(min(sum(inertia), LARGEST)).cast("bigint").alias("inertia"), "centroid_sha256",
        F.lit(measured / max(1, total * clusters)).alias("measured_share"),
    )
