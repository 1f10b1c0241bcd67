"""Linear scorers and factorization machines over hashed sparse features, trained by Spark.

A row's features are indices below ``2 ** bits`` with values log(1 + count), scaled to length 1 or
weighted by how surely an index goes with the label in the training rows, alone or beside another one. The training rows, a bounded sample, are written once. Every epoch is one job: each partition goes
over its rows in small batches (AdaGrad on the logistic loss, soft labels allowed), and the driver
averages the partitions' parameters by their rows. A model has a fixed size whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.tables import written
from orderflow.llm.words import chunks

#: (row of each entry, index of each entry), one entry for every occurrence.
Features = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]

TRAIN_ROWS = 20_000
PARTITIONS = 6

PAIR_BLOCK = 1 << 21  # pairs that are held at a time
PAIR_NATS = 20.0  # a pair this sure by chance: 2 in 10^9


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # (2 ** bits, k); k = 0: a linear scorer
    scale: np.ndarray  # what the values of an index are multiplied by

    def scores(self, sparse: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(sparse), -30, 30)))

    def margins(self, sparse: Sparse) -> np.ndarray:
        at = np.flatnonzero(self.scale[sparse.index])
        row, at, x = sparse.row[at], sparse.index[at], sparse.value[at]
        x = x * self.scale[at]
        total = self.bias + np.bincount(row, self.linear[at] * x, sparse.n)
        for f in range(self.factors.shape[1]):
            part = self.factors[at, f] * x
            total += 0.5 * (np.bincount(row, part, sparse.n) ** 2 - np.bincount(row, part**2, sparse.n))
        return total


@dataclass
class Sparse:
    """Entries of ``n`` rows, in order of the rows."""

    n: int
    row: np.ndarray
    index: np.ndarray
    value: np.ndarray


def sparse(n: int, row: np.ndarray, index: np.ndarray, bits: int, unit: bool) -> Sparse:
    """Damped counts of the entries of each row, with ``unit`` scaled to length 1."""
    keys, often = np.unique((row.astype(np.int64) << bits) | index, return_counts=True)
    at = keys >> bits
    value = np.log1p(often)
    if not unit:
        return Sparse(n, at, keys & ((1 << bits) - 1), value)
    norm = np.sqrt(np.bincount(at, value**2, n))
    return Sparse(n, at, keys & ((1 << bits) - 1), value / norm[at])


def drawn(share: float) -> Column:
    """Whether a row is in the sample: a hash of its doc_id, in millionths and 2^-31 of these, lies below ``share``."""
    step = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1_000_000))
    fine = F.pmod(F.xxhash64("doc_id", F.lit(98)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return step + fine < share * 1_000_000


def training_rows(labelled: DataFrame, features: Features, bits: int, unit: bool, label=None) -> DataFrame:
    """Features of a sample of about TRAIN_ROWS rows (doc_id, text, label), the same in every run.

    Rows are taken by a hash of their doc_id; all rows, if there are no more than that. ``label`` gives
    the labels of a chunk of (doc_id, text) rows that have none yet.
    """
    total = labelled.count()
    share = min(1.0, TRAIN_ROWS / max(1, total))
    chosen = labelled.where(drawn(share))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                found = sparse(chunk.num_rows, *features(chunk), bits, unit)
                opens = pa.array(np.searchsorted(found.row, np.arange(chunk.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column("doc_id"), pa.array(label(chunk)) if label else chunk.column("label"),
                        pa.ListArray.from_arrays(opens, pa.array(found.index, pa.int32())),
                        pa.ListArray.from_arrays(opens, pa.array(found.value, pa.float32())),
                    ],
                    ["doc_id", "label", "at", "x"],
                )

    schema = "doc_id bigint, label double, at array<int>, x array<float>"
    dealt = chosen.select("doc_id", "text", *([] if label else ["label"])).mapInArrow(rows, schema)
    return written(dealt.repartition(PARTITIONS, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(5))), "training")


def evidence(rows: DataFrame, bits: int) -> np.ndarray:
    """For each index how surely it goes with a label: 0 below 3 standard deviations, at most 1.

    Indices of few rows can't be sure, so what only single rows hold is not learnt by heart.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ones = np.zeros(size, np.int32), np.zeros(size, np.float32)
        for batch in batches:
            at = batch.column("at")
            index = at.flatten().to_numpy()
            held += np.bincount(index, minlength=size).astype(np.int32)
            ones += np.bincount(index, np.repeat(batch.column("label").to_numpy(), np.diff(at.offsets.to_numpy())), size).astype(np.float32)
        yield pa.RecordBatch.from_pylist([{"held": held.tobytes(), "ones": ones.tobytes()}])

    held, ones = np.zeros(size), np.zeros(size)
    for r in rows.mapInArrow(count, "held binary, ones binary").collect():  # a row for each of the partitions
        held += np.frombuffer(r["held"], np.int32)
        ones += np.frombuffer(r["ones"], np.float32)
    mean = rows.agg(F.avg("label")).first()[0] or 0.0
    sure = np.abs(ones - held * mean) / np.sqrt(np.maximum(held * mean * (1 - mean), 0.25))
    return np.where(held >= 4, np.clip((sure - 3) / 5, 0, 1), 0.0)


def _sure(ones: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Whether sums of labels lie further from what is expected than chance brings about among all pairs.

    By Chernoff's bound; the expectation is kept from nothing, so a few rows are never sure.
    """
    expected = np.maximum(expected, 0.05)
    return ones * np.log(np.maximum(ones, 1e-9) / expected) - ones + expected >= PAIR_NATS


def _packed(index: np.ndarray) -> bytes:
    """Sorted indices as their steps, byte by byte of all of them, so that they take little room."""
    return zlib.compress(np.diff(index, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.int32)


def pair_evidence(rows: DataFrame, bits: int, alone: Model) -> np.ndarray:
    """1 for each index that with another one goes with a label beyond what ``alone`` makes of the rows, else 0.

    ``alone`` is a linear scorer of the rows. Each task gets the indices of all training rows and counts
    the pairs whose lower index is its own, all of them but those of an index that is too rare for any sure pair.
    """
    model = rows.sparkSession.sparkContext.broadcast(alone)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            x = batch.column("x").flatten().to_numpy().astype(np.float64)
            scores = model.value.scores(Sparse(batch.num_rows, row, at.flatten().to_numpy(), x))
            packed = [_packed(np.asarray(own)) for own in np.split(at.flatten().to_numpy(), at.offsets.to_numpy()[1:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("label"), pa.array(scores)], ["at", "label", "score"])

    def members(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        label, score = table.column("label").to_numpy(), table.column("score").to_numpy()
        each = [_unpacked(x.as_py()) for x in table.column("at")]
        index, row = np.concatenate(each), np.repeat(np.arange(len(label), dtype=np.int32), [len(x) for x in each])
        able = _sure(np.bincount(index, label[row], 1 << bits), np.zeros(1)) | (np.bincount(index, score[row], 1 << bits) >= PAIR_NATS)
        names = np.flatnonzero(able)
        used = able[index]
        index, row = (np.cumsum(able, dtype=np.int32) - 1)[index[used]], row[used]
        ends = np.searchsorted(row, np.arange(len(label)), side="right")
        order = np.argsort(index, kind="stable").astype(np.int32)
        opens = np.searchsorted(index[order], np.arange(len(names) + 1))

        def sums(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
            """By higher index, the weights of the rows that hold it after these places."""
            total, sizes = np.zeros(len(names)), ends[row[places]] - places - 1
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIR_BLOCK, sizes.sum(), PAIR_BLOCK))
            for own, n in zip(np.split(places, cuts), np.split(sizes, cuts)):
                flat = np.arange(n.sum()) + np.repeat(own + 1 - np.cumsum(n) + n, n)
                total += np.bincount(index[flat], np.repeat(weights[row[own]], n), len(names))
            return total

        found = np.zeros(len(names), dtype=bool)
        for low in range(part, len(names), PARTITIONS):
            places = order[opens[low] : opens[low + 1]].astype(np.int64)
            both = _sure(sums(places[label[row[places]] > 0], label), sums(places, score))
            found |= both
            found[low] |= both.any()
        return pa.table({"at": pa.array(names[found], pa.int64())})

    dealt = rows.mapInArrow(scored, "at binary, label double, score double").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS - 1)))
    )
    found = dealt.repartitionByRange(PARTITIONS, "part").groupBy("part").applyInArrow(members, "at bigint").distinct().toArrow()
    paired = np.zeros(1 << bits)
    paired[found.column("at").to_numpy()] = 1
    model.unpersist()
    return paired


class _Learner:
    """One partition's pass of an epoch."""

    def __init__(self, model: Model, past: tuple[float, np.ndarray, np.ndarray], rate: float, decay: float) -> None:
        self.model, self.rate, self.decay = model, rate, decay
        self.bias_past, self.linear_past, self.factors_past = past[0], past[1].copy(), past[2].copy()
        model.linear, model.factors = model.linear.copy(), model.factors.copy()

    def batch(self, rows: Sparse, label: np.ndarray, weight: np.ndarray) -> None:
        m = self.model
        error = (m.scores(rows) - label) * weight / rows.n
        used = np.flatnonzero(m.scale[rows.index])
        rows = Sparse(rows.n, rows.row[used], rows.index[used], rows.value[used] * m.scale[rows.index[used]])
        at, back = np.unique(rows.index, return_inverse=True)
        push = error[rows.row] * rows.value
        slope = np.bincount(back, push, len(at)) + self.decay * m.linear[at]
        self.bias_past += error.sum() ** 2
        m.bias -= self.rate * error.sum() / (1e-8 + self.bias_past**0.5)
        slopes = []
        for f in range(m.factors.shape[1]):
            part = m.factors[rows.index, f] * rows.value
            whole = np.bincount(rows.row, part, rows.n)
            slopes.append(np.bincount(back, push * (whole[rows.row] - part), len(at)) + self.decay * m.factors[at, f])
        self.linear_past[at] += slope**2
        m.linear[at] -= self.rate * slope / (1e-8 + np.sqrt(self.linear_past[at]))
        for f, slope in enumerate(slopes):
            self.factors_past[at, f] += slope**2
            m.factors[at, f] -= 0.3 * self.rate * slope / (1e-8 + np.sqrt(self.factors_past[at, f]))


def train(
    rows: DataFrame, bits: int, factors: int, epochs: int, weigh: bool, balance: bool, rate: float = 0.5, decay: float = 1e-5, batch_rows: int = 32
) -> Model:
    """A model of ``rows`` as training_rows() writes them; ``weigh`` scales indices by evidence() and, with factors, pair_evidence(), ``balance`` rows so that both labels weigh the same."""
    size = 1 << bits
    start = np.random.default_rng(17).normal(0, 0.01, (size, factors))
    scale = evidence(rows, bits) if weigh else np.ones(size)
    if weigh and factors:
        alone = train(rows, bits, 0, epochs, weigh, balance=False, rate=rate, decay=decay, batch_rows=batch_rows)
        scale = np.maximum(scale, pair_evidence(rows, bits, alone))
    model = Model(0.0, np.zeros(size), start, scale)
    past = (1e-3, np.full(size, 1e-6), np.full((size, factors), 1e-6))
    total, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total:
        return model
    heavy = min(20.0, max(0.05, (total - ones) / ones)) if ones and balance else 1.0
    kinds = "n bigint, bias double, bias_past double, at binary, linear binary, linear_past binary, factors binary, factors_past binary"
    for _ in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast((model, past))

        def epoch(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, before = shared.value
            learner = _Learner(Model(now.bias, now.linear, now.factors, now.scale), before, rate, decay)
            n, touched = 0, np.zeros(size, dtype=bool)
            for batch in batches:
                for a in range(0, batch.num_rows, batch_rows):
                    part = batch.slice(a, batch_rows)
                    at, x = part.column("at"), part.column("x")
                    counts = np.diff(at.offsets.to_numpy())
                    index = at.flatten().to_numpy().astype(np.int64)
                    label = part.column("label").to_numpy()
                    touched[index] = now.scale[index] > 0
                    learner.batch(
                        Sparse(part.num_rows, np.repeat(np.arange(part.num_rows), counts), index, x.flatten().to_numpy().astype(np.float64)),
                        label, np.where(label >= 0.5, max(1.0, heavy), max(1.0, 1 / heavy)),
                    )
                    n += part.num_rows
            if n:
                seen = np.flatnonzero(touched)
                m = learner.model
                yield pa.RecordBatch.from_pylist([{
                    "n": n, "bias": float(m.bias), "bias_past": float(learner.bias_past), "at": seen.astype("<u4").tobytes(),
                    "linear": m.linear[seen].astype("<f4").tobytes(), "linear_past": learner.linear_past[seen].astype("<f4").tobytes(),
                    "factors": m.factors[seen].astype("<f4").tobytes(), "factors_past": learner.factors_past[seen].astype("<f4").tobytes(),
                }])

        # an index is averaged over the partitions that met it, the others have no say in it
        weight = np.zeros(size)
        linear, linear_past = np.zeros(size), np.zeros(size)
        vectors, vectors_past = np.zeros((size, factors)), np.zeros((size, factors))
        bias = bias_past = 0.0
        for r in rows.mapInArrow(epoch, kinds).collect():  # a row for each of the partitions, of a bounded size
            seen, n = np.frombuffer(r["at"], "<u4"), r["n"]
            weight[seen] += n
            linear[seen] += n * np.frombuffer(r["linear"], "<f4")
            linear_past[seen] += n * np.frombuffer(r["linear_past"], "<f4")
            vectors[seen] += n * np.frombuffer(r["factors"], "<f4").reshape(len(seen), factors)
            vectors_past[seen] += n * np.frombuffer(r["factors_past"], "<f4").reshape(len(seen), factors)
            bias += n * r["bias"] / total
            bias_past += n * r["bias_past"] / total
        met = weight > 0
        w = weight[met]
        new = Model(bias, model.linear.copy(), model.factors.copy(), model.scale)
        new.linear[met], new.factors[met] = linear[met] / w, vectors[met] / w[:, None]
        past = (bias_past, past[1].copy(), past[2].copy())
        past[1][met], past[2][met] = linear_past[met] / w, vectors_past[met] / w[:, None]
        shared.unpersist()
        model = new
    return model


@dataclass
class Scorer:
    """Scores a chunk of documents, from 0 to 1. It carries the model in 32 bits."""

    model: Model
    features: Features
    bits: int
    unit: bool

    def __post_init__(self) -> None:
        m = self.model
        self.model = Model(m.bias, m.linear.astype(np.float32), m.factors.astype(np.float32), m.scale.astype(np.float32))

    def __call__(self, chunk: pa.RecordBatch) -> np.ndarray:
        return self.model.scores(sparse(chunk.num_rows, *self.features(chunk), self.bits, self.unit))
