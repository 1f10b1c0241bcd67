"""Token ids of a shard as a wavelet matrix: one file that is compressed and answers queries.

The shard's ids are stored as bit planes, top bit first. In each plane the ids are in the order that
a stable partition by all higher bits leaves them in, and a directory holds the number of ones before
every 512 bits. That gives access to an id, the count of a token in a range and the place of its k-th
occurrence in a number of steps that is the number of planes, without unpacking the shard.

A shard file is Parquet (zstd) with a row per matrix: documents in ascending doc_id order, never
split. Null texts count as empty: their only id is the end id. Null doc_ids come first; rows with one
doc_id stay, ordered by text. An empty table writes no matrix and gives no row. Other columns of
the input do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.tables import parts
from orderflow.llm.tokens import encoder, released
from orderflow.llm.words import chunks
from orderflow.sources.shared_folder import new_folder

#: Tokens of a shard, or a document more: its arrays stay in a processor's cache.
SHARD_TOKENS = 1 << 19
PARTITION_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
RANK_BITS = 512

SHARDS = (
    "shard bigint, n_tokens bigint, planes array<binary>, ranks array<binary>, zeros array<bigint>, "
    "doc_ids array<bigint>, doc_tokens array<bigint>"
)

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for place in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << place)) != 0
            packed = np.packbits(ones, bitorder="little")
            step = RANK_BITS // 8
            blocks = np.add.reduceat(_ONES[packed], np.arange(0, len(packed), step), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4"))
            zeros.append(len(now) - int(np.count_nonzero(ones)))
            now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
        return cls(len(ids), planes, ranks, zeros)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says where its two halves were."""
        bits = len(self.planes)
        now = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            above[np.flatnonzero(ones)] = now[self.zeros[level] :] | now.dtype.type(1 << (bits - 1 - level))
            now = above
        return now

    def _rank(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        plane, block = self.planes[level], i // RANK_BITS
        byte = block * RANK_BITS // 8
        count = int(self.ranks[level][block]) + int(_ONES[plane[byte : i >> 3]].sum())
        return count + (int(_ONES[plane[i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def _select(self, level: int, one: bool, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not one:
            ranks = np.minimum(np.arange(len(ranks)) * RANK_BITS, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        at = block * RANK_BITS
        bits = np.unpackbits(self.planes[level][at // 8 : at // 8 + RANK_BITS // 8], count=min(RANK_BITS, self.n - at), bitorder="little")
        return at + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            before = self._rank(level, i)
            one = self._rank(level, i + 1) - before
            value = 2 * value + one
            i = zeros + before if one else i - before
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank(level, low), self._rank(level, high)
            if token >> (len(self.zeros) - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token occurs in [low, high)."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(token >> (len(self.zeros) - 1 - level) & 1)
            at = self._select(level, one, at - (self.zeros[level] if one else 0))
        return at


def matrix_of(row) -> WaveletMatrix:
    """The matrix of a row of a shard file."""
    return WaveletMatrix(
        row["n_tokens"],
        [np.frombuffer(p, np.uint8) for p in row["planes"]],
        [np.frombuffer(r, "<u4") for r in row["ranks"]],
        list(row["zeros"]),
    )


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Encode ``docs`` in ascending doc_id order and write the shard files."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bits = max(1, (max(encode.vocabulary - 1, end_id)).bit_length())
        number = TaskContext.get().partitionId() << 32
        tokens, docs_held, sizes = np.zeros(0, np.uint32), [], np.zeros(0, np.int64)

        def shard(ids: np.ndarray, names: list, counts: np.ndarray) -> pa.RecordBatch:
            matrix = WaveletMatrix.build(ids, bits)
            return pa.RecordBatch.from_pylist(
                [{
                    "shard": number, "n_tokens": matrix.n, "planes": [p.tobytes() for p in matrix.planes],
                    "ranks": [r.tobytes() for r in matrix.ranks], "zeros": matrix.zeros, "doc_ids": names, "doc_tokens": counts.tolist(),
                }],
                schema,
            )

        for batch in released(batches):
            for chunk in chunks(batch, most=CHUNK_BYTES):
                found, first = encode.encode_array(chunk.column("text"))
                tokens = np.concatenate([tokens, np.insert(found, first[1:], end_id)])  # the end id of each document
                docs_held += chunk.column("doc_id").to_pylist()
                sizes = np.concatenate([sizes, np.diff(first) + 1])
                while len(tokens) >= SHARD_TOKENS:  # whole documents
                    n = int(np.searchsorted(np.cumsum(sizes), SHARD_TOKENS)) + 1
                    at = int(sizes[:n].sum())
                    yield shard(tokens[:at], docs_held[:n], sizes[:n])
                    tokens, docs_held, sizes, number = tokens[at:], docs_held[n:], sizes[n:], number + 1
        if docs_held:
            yield shard(tokens, docs_held, sizes)

    blobs, longs = pa.list_(pa.binary()), pa.list_(pa.int64())
    schema = pa.schema(
        [("shard", pa.int64()), ("n_tokens", pa.int64()), ("planes", blobs), ("ranks", blobs), ("zeros", longs), ("doc_ids", longs), ("doc_tokens", longs)]
    )
    (
        rows.repartitionByRange(parts(total, PARTITION_BYTES), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(shards, SHARDS)
        .write.option("compression", "zstd")
        .parquet(folder)
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, decoded from the shard files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = matrix_of(row).decode().astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), row["shard"])), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64()),
                    ],
                    ["shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SHARDS).parquet(folder)
    # a row for each shard, summed within its task's; over the tasks, a row for each task
    task = F.shiftright("shard", 32).alias("task")
    sums = shards.select("shard", task, "n_tokens")
    by_task = sums.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    over_tasks = by_task.select("task", (F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    within = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    before = sums.withColumn("within", within).join(over_tasks, "task").select("shard", (F.col("start") + F.col("within")).alias("base"))
    found = shards.mapInArrow(rows, "shard bigint, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(before, "shard").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard"
    )


def wavelet_shards(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents as shards and return what the files hold for each."""
    folder = new_folder(docs.sparkSession, "wavelet")
    write_shards(docs, tokenizer, end_id, folder)
    return read_documents(docs.sparkSession, folder)
