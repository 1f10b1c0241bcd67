"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of the whole text and their first five bytes, hashed; beside a weight
for each term the machine learns a vector, so pairs of terms that are harmless apart can weigh
together. A term counts if it goes with the label alone or in a pair, over all pairs of the sample. It learns from a bounded sample (``hashed_model.TRAIN_ROWS``) of the labelled rows outside the
held-out fold. Language, source and ids are no inputs of a score.

Null and empty texts have no terms and get the score of the bias alone. Null labels are no labels; of
several labels of a doc_id the largest counts. Every row is scored, rows with one doc_id too; a null
doc_id is never learnt from and its fold is that of an empty id. Without any labels all scores are 0.5
and nothing is predicted toxic. An empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.hashed_model import Model, Scorer, train, training_rows
from orderflow.llm.words import Words, chunks, texts_of, word_hashes, words_of

BITS = 18
FACTORS = 4
EPOCHS = 6
FOLDS = 5
PREFIX = 5


def terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = texts_of(batch.column("text"))
    words = words_of(texts)
    row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
    # sentence marks at the end of a word are no part of its term
    end = words.end.copy()
    for _ in range(3):
        end -= (end - words.start > 1) & np.isin(texts.data[end - 1], list(b".,;:!?\"')*#$%&"))
    bare = Words(words.start, end, words.first)
    stems = Words(words.start, np.minimum(end, words.start + PREFIX), words.first)
    shift = np.uint64(64 - BITS)
    whole = (word_hashes(texts, bare, lower=True) >> shift).astype(np.int64)
    stem = ((word_hashes(texts, stems, lower=True) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)
    return np.concatenate([row, row]), np.concatenate([whole, stem])


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    marks = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("double").alias("label"))
        .where(~held_out())
    )
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return train(training_rows(texts.join(marks, "doc_id"), terms, BITS, unit=False), BITS, FACTORS, EPOCHS, weigh=True, balance=True)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scores = docs.sparkSession.sparkContext.broadcast(Scorer(model, terms, BITS, unit=False))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array(scores.value(chunk).astype(np.float64))], ["doc_id", "score"]
                )

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(rows, "doc_id bigint, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
