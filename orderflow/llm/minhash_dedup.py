"""Near-duplicates by HyperMinHash.

1. ``fingerprints``: the distinct word shingles of the whole text, hashed; 128 minima of random
   linear hashes, each kept as a 16-bit register: leading zeros (6 bits) and mantissa (10 bits).
   Texts with equal shingle sets are one class (by a 128-bit digest), represented by its smallest id.
2. ``candidates``: registers are banded by four. In a bucket, a representative is linked with others
   whose registers give a collision-corrected Jaccard estimate over a floor well below the
   similarity asked for. The result is a spanning forest of each bucket, not its pairs.
3. ``verified``: each connected set of candidates is brought together once with its texts, and
   every pair that could still join two components is compared on the full sets.

A pair at Jaccard 0.8 shares no band with probability 5e-8 and falls below the floor with 4e-6.
Large buckets and candidate sets are cut into blocks whose pairs are compared one by one, so
no task holds an unbounded group and no link is lost.

A null or empty text has no shingles and links with nothing; its component is itself. A text of
fewer words than a shingle has one, its whole sequence. Rows with one doc_id are one document; a
null doc_id links with nothing and is kept. An empty table gives an empty result. Other columns
of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.components import components
from orderflow.llm.groups import reach, whole_groups
from orderflow.llm.tables import fresh, written
from orderflow.llm.words import chunks, mix, texts_of, word_hashes, words_of

REGISTERS = 128
MANTISSA_BITS = 10
BAND = 4
BUCKET_BLOCK = 1500  # representatives of a bucket that one block holds
SHINGLE_BLOCK = 400_000  # shingles of a candidate set that one block holds
MARGIN = 4.5  # standard deviations between the floor of the estimate and the similarity

_random = np.random.default_rng(8128)
_FACTORS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)

#: Chance that registers of two different minima agree: 0.169919487 * 2^-mantissa bits.
COLLISION = 0.169919487 / (1 << MANTISSA_BITS)

PRINTS = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"


def shingle_sets(batch: pa.RecordBatch, words_each: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts_of(batch.column("text"))
    words = words_of(texts)
    hashes = word_hashes(texts, words, lower=True)
    rolled = hashes.copy()
    for j in range(1, min(words_each, len(hashes))):
        rolled[: len(rolled) - j] = mix(rolled[: len(rolled) - j]) + hashes[j:]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= words_each:
            sets.append(np.unique(rolled[a : b - words_each + 1]))
        elif b > a:
            whole = hashes[a:b][:1]
            for j in range(a + 1, b):
                whole = mix(whole) + hashes[j]
            sets.append(mix(whole ^ np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The compressed minima of sets that are not empty: (len(sets), REGISTERS) of 16 bits."""
    values = np.concatenate(sets)
    opens = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(values * _FACTORS[i] + _SHIFTS[i], opens)
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint16)
    mantissa = np.maximum((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA_BITS)) | mantissa


def fingerprints(docs: DataFrame, words_each: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = REGISTERS // BAND
        for batch in batches:
            for chunk in chunks(batch):
                sets = shingle_sets(chunk, words_each)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                packed = registers(full).view("<i8").ravel() if full else np.zeros(0, np.int64)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * width)]), pa.int32()), pa.array(packed, pa.int64())
                )
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), bands],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(rows, PRINTS)


def _block_pairs(blocks):
    """The pairs of blocks, own block included, that a row of block ``block`` takes part in."""
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    return other


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Rows with (block, blocks), once for each pair of blocks that they take part in, as (low, high)."""
    return rows.withColumn("other", _block_pairs(F.col("blocks"))).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    ).drop("block", "blocks", "other")


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that span, bucket by bucket, the representatives with similar registers."""
    floor = similarity - MARGIN * (similarity * (1 - similarity) / REGISTERS) ** 0.5
    least = int(np.floor(REGISTERS * (floor * (1 - COLLISION) + COLLISION)))
    named = classes.select("rep", F.posexplode("bands").alias("place", "band")).select(
        "rep", F.xxhash64("place", "band").alias("bucket")
    )
    shared = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = _in_pairs(
        named.join(shared, "bucket").select(
            "rep",
            "bucket",
            F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"),
            F.pmod(F.xxhash64("rep", "bucket"), F.ceil(F.col("n") / BUCKET_BLOCK)).cast("int").alias("block"),
        )
    )
    rows = rows.join(classes.select("rep", "bands"), "rep")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["bucket", "low", "high"]):
            ids = group.column("rep").to_numpy()
            if len(ids) < 2:
                continue
            flat = group.column("bands").combine_chunks().flatten().to_numpy().view("<u2")
            sketch = flat.reshape(len(ids), REGISTERS)
            root = reach(len(ids), lambda i, rest: np.count_nonzero(sketch[rest] == sketch[i], axis=1) >= least)
            joined = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[root[joined]])], ["a", "b"])

    return (
        rows.repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(links, "a bigint, b bigint")
    )


def verified(docs: DataFrame, members: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Links (a, b) confirmed on full shingle sets, spanning the members of each candidate set."""
    percent = round(100 * similarity)
    sizes = members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.col("total") / SHINGLE_BLOCK)
    rows = _in_pairs(
        members.join(sizes, "cluster").select(
            "id", "cluster", blocks.cast("int").alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")
        )
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"))
    rows = texts.join(rows.hint("merge"), "id")  # texts move once, whatever the members' number

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["cluster", "low", "high"]):
            ids = group.column("id").to_numpy()
            if len(ids) < 2:
                continue
            sets = [s for b in group.to_batches() for c in chunks(b) for s in shingle_sets(c, words_each)]
            root = reach_by_sets(sets, percent)
            joined = np.flatnonzero((root != np.arange(len(ids))) & (ids[root] != ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[root[joined]])], ["a", "b"])

    return (
        rows.repartition("cluster", "low", "high")
        .sortWithinPartitions("cluster", "low", "high")
        .mapInArrow(links, "a bigint, b bigint")
    )


def reach_by_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Members that links of ``100 * intersection >= percent * union`` connect, by exact counts."""
    sizes = np.array([len(s) for s in sets])
    opens = np.concatenate([[0], np.cumsum(sizes)])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.uint8)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        # a pair can only pass if the smaller set is large enough
        fits = (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)
        some = rest[fits]
        if len(some) == 0 or sizes[i] == 0:
            return np.zeros(len(rest), dtype=bool)
        own = codes[opens[i] : opens[i + 1]]
        mark[own] = 1
        if len(some) > 0.5 * len(sizes):
            sums = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(mark[codes], out=sums[1:])
            both = sums[opens[some + 1]] - sums[opens[some]]
        else:
            both = np.array([np.count_nonzero(mark[codes[opens[k] : opens[k + 1]]]) for k in some])
        mark[own] = 0
        hit = np.zeros(len(rest), dtype=bool)
        hit[fits] = 100 * both >= percent * (sizes[some] + sizes[i] - both)
        return hit

    return reach(len(sets), near)


def near_duplicates(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    prints = written(fingerprints(docs, words_each), "prints")
    classes = written(
        prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.min_by("bands", "doc_id").alias("bands")),
        "classes",
    )
    clusters = components(candidates(classes, similarity)).withColumnRenamed("component", "cluster")
    sized = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n_shingles"))
    members = written(clusters.join(sized, "id"), "members")
    found = components(verified(docs, members, words_each, similarity))
    named = classes.select("digest", "rep").join(found, F.col("rep") == F.col("id"), "left").select(
        "digest", F.coalesce("component", "rep").alias("reached")
    )
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("reached")).otherwise(F.col("doc_id"))
    return (
        prints.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each group."""
    found = near_duplicates(docs, words_each, similarity)
    name = fresh(docs, "dropped_id")[0]
    dropped = written(found.where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(dropped.hint("merge"), F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
