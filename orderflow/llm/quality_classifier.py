"""A quality classifier from weak labels: no marked documents are needed.

1. Heuristic labellers vote good, bad or nothing on every document; they overlap and are fallible.
2. Expectation-maximisation over the counts of all vote patterns estimates how often each labeller
   votes each way on good and on bad documents, and with that the chance that a pattern means good.
3. The documents' chances train a linear scorer over hashed word shapes, on a bounded sample
   (``hashed_model.TRAIN_ROWS``). The scorer judges every document.

Null and empty texts get no vote and the bias as score. Every row is scored, rows with one doc_id too; a
null doc_id is scored but not learnt from. An empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.hashed_model import Model, Scorer, train, training_rows
from orderflow.llm.quality_rules import measure
from orderflow.llm.words import Texts, Words, chunks, mix, texts_of, word_hashes, words_of

BITS = 14
EPOCHS = 6
ROUNDS = 50

GOOD, BAD = 1, -1

#: A text of n words with no more different ones than this many times the root of n has little variety. It meets
#: the fifth of all words at 2,000 words.
FEW_ROOTS = 9


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, 0))


def _share(name: str, good: float, bad: float) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Votes by the share of words that a measurement counts."""

    def vote(m: dict[str, np.ndarray]) -> np.ndarray:
        share = m[name] / np.maximum(m["n_words"], 1)
        return _vote((share <= good) & (m["n_words"] > 0), share >= bad)

    return vote


def _word_length(m: dict[str, np.ndarray]) -> np.ndarray:
    mean = m["word_chars"] / np.maximum(m["n_words"], 1)
    usual = (mean >= 3.5) & (mean <= 6.5) & (m["n_words"] > 0)
    return _vote(usual, (m["n_words"] > 0) & ((mean < 2) | (mean > 25)))


def _lines(m: dict[str, np.ndarray]) -> np.ndarray:
    share = m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
    return _vote((m["n_lines"] >= 4) & (share <= 0.1), share >= 0.6)


def _variety(m: dict[str, np.ndarray]) -> np.ndarray:
    """Few different words are bad: a fifth of a text at most, and in long ones, which say words again, some square roots."""
    share = m["n_distinct"] / np.maximum(m["n_words"], 1)
    usual = share >= 0.45
    few = np.minimum(0.2 * m["n_words"], FEW_ROOTS * np.sqrt(m["n_words"]))
    return _vote(usual & (m["n_words"] > 0), (m["n_distinct"] <= few) & (m["n_words"] >= 20))


def _plain(m: dict[str, np.ndarray]) -> np.ndarray:
    odd = m["n_symbols"] + m["n_shouted_words"] + m["n_same_words"]
    return _vote((20 * odd <= m["n_words"]) & (m["n_words"] > 0), 4 * odd >= np.maximum(m["n_words"], 1))


LABELLERS: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "symbols": _share("n_symbols", 0.05, 0.3),
    "shouting": _share("n_shouted_words", 0.02, 0.3),
    "runs": _share("n_same_words", 0.1, 0.3),
    "windows": _share("n_repeat_words", 0.1, 0.6),
    "lines": _lines,
    "variety": _variety,
    "word_length": _word_length,
    "plain": _plain,
}


def votes(batch: pa.RecordBatch) -> np.ndarray:
    """A number for the votes of all labellers, base 3, for each document of a chunk."""
    m = measure(batch)
    texts = texts_of(batch.column("text"))
    words = words_of(texts)
    hashes = word_hashes(texts, words, lower=True)
    m["n_distinct"] = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.first, words.first[1:])], np.int64)
    pattern = np.zeros(batch.num_rows, np.int64)
    for labeller in LABELLERS.values():
        pattern = 3 * pattern + labeller(m) + 1
    return pattern


def unpack(patterns: np.ndarray) -> np.ndarray:
    """(patterns, labellers) votes of 0 (bad), 1 (none), 2 (good)."""
    columns = []
    for _ in LABELLERS:
        columns.append(patterns % 3)
        patterns = patterns // 3
    return np.stack(columns[::-1], axis=1)


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern the chance of good, and (labellers, class, vote) rates.

    A labeller's rates of bad and good votes are estimated among good and among bad documents,
    which are the unknown; a labeller that gives no vote says nothing. The start trusts bad votes,
    as labellers vote good on whatever they see nothing odd in. Smoothing keeps every rate from 0.
    """
    cast = unpack(patterns)
    bad, good = (cast == 0).sum(1), (cast == 2).sum(1)
    chance = np.where(bad > 0, np.clip(0.6 - 0.2 * bad, 0.05, 0.5), np.where(good > 0, 0.95, 0.6))
    rates = np.ones((cast.shape[1], 2, 3))
    for _ in range(ROUNDS):
        prior = np.clip((counts * chance).sum() / counts.sum(), 0.01, 0.99)
        for k in range(cast.shape[1]):
            for v in (0, 2):
                here = cast[:, k] == v
                rates[k, 1, v] = (counts * chance * here).sum() + 0.5
                rates[k, 0, v] = (counts * (1 - chance) * here).sum() + 0.5
        rates /= rates[:, :, [0, 2]].sum(axis=2, keepdims=True)
        rates[:, :, 1] = 1
        odds = np.log(prior / (1 - prior)) + sum(np.log(rates[k, 1, cast[:, k]] / rates[k, 0, cast[:, k]]) for k in range(cast.shape[1]))
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return chance, rates


_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[97:123] = 97
_CLASSES[65:91] = 65
_CLASSES[48:58] = 48
_CLASSES[128:] = 97


def shapes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shapes: how a word begins and ends, alone and with the next; repeated words and lines."""
    texts = texts_of(batch.column("text"))
    words = words_of(texts)
    sizes = np.diff(words.first)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    classes = Texts(_CLASSES[texts.data], texts.offsets)
    begins = word_hashes(classes, Words(words.start, np.minimum(words.start + 2, words.end), words.first))
    ends = word_hashes(classes, Words(np.maximum(words.end - 2, words.start), words.end, words.first))
    shape = mix(begins * np.uint64(3) + ends)
    following = mix(shape[:-1] * np.uint64(5) + shape[1:]) if len(shape) else shape
    plain = word_hashes(texts, words, lower=True)
    same = np.flatnonzero((plain[1:] == plain[:-1]) & (row[1:] == row[:-1])) if len(plain) else np.zeros(0, np.int64)
    near = np.flatnonzero(row[1:] == row[:-1]) if len(plain) else np.zeros(0, np.int64)
    m = measure(batch)
    rows, found = [row, row[near], row[same]], [shape, following[near], np.full(len(same), 11, np.uint64)]
    for mark, name in enumerate(("n_dup_lines", "n_repeat_words"), 21):
        rows.append(np.repeat(np.arange(batch.num_rows), m[name]))
        found.append(np.full(len(rows[-1]), mark, np.uint64))
    index = mix(np.concatenate(found).astype(np.uint64)) >> np.uint64(64 - BITS)
    return np.concatenate(rows), index.astype(np.int64)


def fit(docs: DataFrame) -> Model:
    """The scorer, from the votes on all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for chunk in chunks(batch):
                counts += np.bincount(votes(chunk), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pattern", "n"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    table = texts.mapInArrow(rows, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    patterns, counts = table.column("pattern").to_numpy(), table.column("n").to_numpy()  # at most 3 ** labellers
    chance_of = np.full(3 ** len(LABELLERS), 0.5)
    if len(patterns):
        chance_of[patterns] = posteriors(patterns, counts)[0]

    def label(chunk: pa.RecordBatch) -> np.ndarray:
        return chance_of[votes(chunk)]

    return train(
        training_rows(texts.where("doc_id IS NOT NULL"), shapes, BITS, unit=True, label=label), BITS, 0, EPOCHS, weigh=False, balance=False
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, kept) of every document; kept: the score for good is 0.5 or more."""
    scores = docs.sparkSession.sparkContext.broadcast(Scorer(model, shapes, BITS, unit=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array(scores.value(chunk).astype(np.float64))], ["doc_id", "score"]
                )

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(rows, "doc_id bigint, score double")
    return found.withColumn("kept", F.col("score") >= 0.5)


def quality(docs: DataFrame) -> DataFrame:
    return score(docs, fit(docs))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    scores = docs.sparkSession.sparkContext.broadcast(Scorer(fit(docs), shapes, BITS, unit=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                yield chunk.filter(pa.array(scores.value(chunk) >= 0.5))

    return docs.mapInArrow(rows, docs.schema)
