"""Lexical retrieval packing into windows of a fixed number of tokens.

Documents are encoded once and laid out by a min-hash of their tokens, so that documents which
share tokens come to lie in the same shards. A shard holds a BM25 inverted index over its documents
(terms are token ids; document frequencies and mean length are those of the whole corpus). A
document first fills whole windows of its own. Its rest becomes a seed: the index returns the unused
documents of the shard that are nearest to it, which fill the seed's window one after another; the
last is cut and what is left of it stays in the pool. Documents that no window could be filled with
go on into the next shard, so only the last window of a partition is padded.

Of documents with equal scores the first of the shard is taken; a very long text fills whole windows of its own.
Null texts count as empty: their only id is the end id. Each row is packed, rows with one doc_id
too; a null doc_id stays null. An empty table gives no piece. Other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.tables import parts, written
from orderflow.llm.tokens import encoder, released
from orderflow.llm.words import chunks, mix

K1, B = 1.2, 0.75
SHARD_DOCS = 512
SHARD_TOKENS = 2_000_000
PARTITION_TOKENS = 8_000_000
#: Terms that at least this share of a shard's documents hold are scored as a matrix.
COMMON = 1 / 16
CHUNK_BYTES = 4 << 20

#: A row for each document, and behind them one for each task: in how many of its documents each id occurs.
ENCODED = "row bigint, doc_id bigint, sketch bigint, n bigint, ids binary, often binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, row bigint, ids binary"
)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of each text (two bytes each where the vocabulary allows), a min-hash of them, and counts a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        size = encode.vocabulary
        wide = np.dtype(_wide(size))
        hashes = mix(np.arange(size, dtype=np.uint64) + np.uint64(1)).view(np.int64)
        often = np.zeros(size, np.int64)
        for batch in released(batches):
            for chunk in chunks(batch, most=CHUNK_BYTES):
                ids, first = encode.encode_array(chunk.column("text"))
                n = np.diff(first)
                sketch, full = np.zeros(len(n), np.int64), np.flatnonzero(n)
                if len(full):
                    sketch[full] = np.minimum.reduceat(hashes[ids], first[full])
                often += occurrences(ids, n, size)
                raw = ids.astype(wide)
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(first.astype(np.int64) * wide.itemsize), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("row"), chunk.column("doc_id"), pa.array(sketch), pa.array(n), own.cast(pa.binary()), pa.nulls(len(n), pa.binary())], _ENCODED
                )
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([often.astype("<i8").tobytes()], pa.binary())], _ENCODED
        )

    numbered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(rows, ENCODED)


_ENCODED = ["row", "doc_id", "sketch", "n", "ids", "often"]


def occurrences(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """In how many of the documents, of ``n`` ids each, every id occurs."""
    kind = np.int32 if len(n) * size < 1 << 31 else np.int64
    both = np.sort(np.repeat(np.arange(len(n), dtype=kind), n) * kind(size) + ids.astype(kind))
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    return np.bincount(both[new] % size, minlength=size)


def _wide(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each id occurs: a number for each entry of the vocabulary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, np.int64)
        for batch in batches:
            for often in batch.column("often"):
                own = np.frombuffer(often.as_buffer(), "<i8")
                found = own.copy() if not len(found) else found + own
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(found[terms])], ["term", "n"])

    counts = tokens.where("often IS NOT NULL").select("often").mapInArrow(rows, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(vocabulary, np.int64)
    table = counts.toArrow()
    found[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return found


class Index:
    """BM25 postings of a shard's documents, by term."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.n, size = len(documents), len(idf)
        sizes = np.array([len(ids) for ids in documents], np.int64)
        kind = np.int32 if self.n * size < 1 << 31 else np.int64
        flat = np.concatenate(documents) if documents else np.zeros(0, kind)
        both = np.sort(np.repeat(np.arange(self.n, dtype=kind), sizes) * kind(size) + flat.astype(kind))
        start = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        both, often = both[start], np.diff(start, append=len(both)).astype(np.float32)
        owner = both // size
        terms = both - owner * size
        norm = (K1 * (1 - B + B * sizes / mean_length)).astype(np.float32)
        weights = idf[terms] * often * np.float32(K1 + 1) / (often + norm[owner])
        # terms of many documents meet as matrices, all documents at once; the others by their postings
        held = np.bincount(terms, minlength=size)
        common = np.flatnonzero(held >= max(2, COMMON * self.n))
        column = np.full(size, -1, np.int32)
        column[common] = np.arange(len(common))
        at = column[terms]
        many, few = at >= 0, np.flatnonzero(at < 0)
        dense, asked = (np.zeros((self.n, len(common)), np.float32) for _ in range(2))
        dense[owner[many], at[many]], asked[owner[many], at[many]] = weights[many], 1
        self.common = asked @ dense.T  # a row for each asking document
        self.terms, self.first = terms[few], np.searchsorted(owner[few], np.arange(self.n + 1))
        order = few[np.argsort(terms[few], kind="stable")]
        self.owners, self.weights = owner[order].astype(np.int32), weights[order]
        held[common] = 0
        self.opens = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)

    def scores(self, k: int) -> np.ndarray:
        """BM25 of all documents for the terms of document ``k``."""
        own = self.terms[self.first[k] : self.first[k + 1]]
        first, sizes = self.opens[own], self.opens[own + 1] - self.opens[own]
        total = int(sizes.sum())
        if not total:
            return self.common[k].astype(np.float64)
        shift = first - np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int32)
        at = np.arange(total, dtype=np.int32) + np.repeat(shift, sizes)
        return self.common[k] + np.bincount(self.owners[at], self.weights[at], self.n)


class Packer:
    """Windows of one partition, shard after shard."""

    def __init__(self, window: int, idf: np.ndarray, mean_length: float, end_id: int, first_id: int, with_ids: bool) -> None:
        self.window, self.idf, self.mean, self.end, self.next = window, idf, mean_length, end_id, first_id
        self.with_ids = with_ids
        self.rest: list[tuple] = []  # (doc_id, terms, all ids with the end, row, start of what is left)

    def _piece(self, doc: tuple, start: int, length: int, offset: int) -> tuple:
        ids = doc[2][start : start + length]
        return doc[0], start, length, zlib.crc32(ids), len(doc[2]), self.next, offset, doc[3], ids.tobytes() if self.with_ids else None

    def shard(self, documents: list[tuple], last: bool) -> list[tuple]:
        """Pieces of the windows that the documents fill; with ``last``, of all that is left."""
        pieces: list[tuple] = []
        pool = self.rest
        for doc_id, terms, row in documents:
            whole = np.append(terms, self.end).astype("<u4")
            doc, start = (doc_id, terms, whole, row), 0
            while len(whole) - start >= self.window:
                pieces.append(self._piece(doc, start, self.window, 0))
                self.next += 1
                start += self.window
            if start < len(whole):
                pool.append((*doc, start))
        index = Index([p[1] for p in pool], self.idf, self.mean)
        starts = [p[4] for p in pool]
        free = np.ones(len(pool), dtype=bool)
        left = sum(len(p[2]) - p[4] for p in pool)
        for seed in range(len(pool)):
            if not free[seed]:
                continue
            if left < self.window and not last:
                break
            scores, offset, now = None, 0, seed
            while True:
                size = min(len(pool[now][2]) - starts[now], self.window - offset)
                pieces.append(self._piece(pool[now], starts[now], size, offset))
                starts[now] += size
                offset += size
                left -= size
                free[now] = starts[now] < len(pool[now][2])
                if offset == self.window or not left:
                    break
                if scores is None:
                    scores = index.scores(seed)
                scores[~free] = -1
                now = int(scores.argmax())
            self.next += 1
        self.rest = [(*pool[k][:4], starts[k]) for k in np.flatnonzero(free)]
        return pieces


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A row for each piece of a document in a window; pieces of a window are gapless from offset 0.

    ``row`` tells apart documents of one doc_id. With ``with_ids`` the ids of a window's pieces, in the order of their
    offsets, are the window.
    """
    both = written(encoded(docs, tokenizer), "tokens")
    tokens = both.where("n IS NOT NULL").drop("often")
    vocabulary = max(encoder(tokenizer).vocabulary, end_id + 1)
    wide = _wide(encoder(tokenizer).vocabulary)
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    often = document_frequencies(both, vocabulary)
    idf = np.log(1 + (count - often + 0.5) / (often + 0.5)).astype(np.float32)
    mean = max(1.0, (total or 0) / max(1, count))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, idf, mean, end_id, TaskContext.get().partitionId() << 32, with_ids)
        held, size = [], 0
        for batch in released(batches):
            for doc_id, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("ids")):
                held.append((doc_id, np.frombuffer(ids.as_buffer(), wide), row))
                size += len(held[-1][1])
                if len(held) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield _batch(packer.shard(held, False))
                    held, size = [], 0
        yield _batch(packer.shard(held, True))

    found = (
        tokens.repartitionByRange(parts((total or 0) + count, PARTITION_TOKENS), "sketch", "doc_id")
        .sortWithinPartitions("sketch", "doc_id", "ids")
        .mapInArrow(rows, PIECES)
    )
    return found if with_ids else found.drop("ids")


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces)) if pieces else [()] * 9
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"]
    arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
    ids = pa.array(columns[8], pa.binary())
    return pa.RecordBatch.from_arrays([*arrays, ids], [*names, "ids"])
