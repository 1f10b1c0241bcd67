"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one bit per
failed rule; a policy is a named set of rules, so applying a policy, comparing versions and
counting what each rule alone rejects are bitwise operations on the ledger and read no text.

Null texts count as empty. An empty text has no words and fails ``too_few_words``. Rows are
judged one by one: repeated rows and doc_ids stay, a null doc_id stays null, an empty table gives
an empty ledger, and other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orderflow.llm.tables import fresh, written
from orderflow.llm.words import Texts, Words, chunks, sums_by_text, texts_of, word_hashes, words_of

WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words", "n_shouted_words",
)

#: A rule fails a document for which this holds; its place in the ledger's bits is its position.
RULES: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "too_few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 4 * m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_runs": lambda m: 10 * m["n_same_words"] > 3 * m["n_words"],
    "shouting": lambda m: 10 * m["n_shouted_words"] > 4 * m["n_words"],
    "word_length": lambda m: (m["word_chars"] > 25 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]),
}

BASE = ("too_few_words", "repeated_windows")

#: Policies by version.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "repeated_lines"), "v2": tuple(RULES)}

LEDGER = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", failed_bits bigint"

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside windows of 8 that a text holds twice or more, by 64-bit window hashes."""
    found = np.zeros(len(first) - 1, np.int64)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return found
    windows = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    for i in range(len(found)):
        own = windows[first[i] : max(first[i], first[i + 1] - WINDOW + 1)]
        if len(own) < 2:
            continue
        order = np.sort(own)
        again = order[1:][order[1:] == order[:-1]]
        if len(again) == 0:
            continue
        at = np.flatnonzero(np.isin(own, again))
        step = np.zeros(len(own) + WINDOW, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + WINDOW, -1)
        found[i] = np.count_nonzero(np.cumsum(step[:-1]))
    return found


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier one."""
    raw = texts.data.tobytes()
    total, again = [], []
    for i in range(len(texts.offsets) - 1):
        lines = [x for x in raw[texts.offsets[i] : texts.offsets[i + 1]].split(b"\n") if x.strip()]
        total.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    return np.array(total, np.int64), np.array(again, np.int64)


def _same_words(hashes: np.ndarray, words: Words) -> np.ndarray:
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    opens = words.first[:-1]
    same[opens[opens < len(hashes)]] = False
    return sums_by_text(same, words.first)


def _shouted(texts: Texts, words: Words) -> np.ndarray:
    last = texts.data[words.end - 1] == ord("!")
    before = texts.data[np.maximum(words.end - 2, 0)] == ord("!")
    return sums_by_text(last & before & (words.end - words.start > 2), words.first)


def measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All measurements and the failure bits of a chunk of documents."""
    texts = texts_of(batch.column("text"))
    words = words_of(texts)
    hashes = word_hashes(texts, words)
    points = (texts.data & 0xC0) != 0x80
    spaces = np.isin(texts.data, list(b" \t\n\v\f\r"))
    lines, again = _lines(texts)
    m = {
        "n_words": np.diff(words.first),
        "word_chars": sums_by_text(points & ~spaces, texts.offsets),
        "n_symbols": sums_by_text(_SYMBOLS[texts.data], texts.offsets),
        "n_lines": lines,
        "n_dup_lines": again,
        "n_repeat_words": _repeat_words(hashes, words.first),
        "n_same_words": _same_words(hashes, words),
        "n_shouted_words": _shouted(texts, words),
    }
    bits = np.zeros(batch.num_rows, np.int64)
    for place, fails in enumerate(RULES.values()):
        bits |= fails(m).astype(np.int64) << place
    return m | {"failed_bits": bits}


def ledger(docs: DataFrame) -> DataFrame:
    """A row of measurements and failure bits for every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                found = measure(chunk)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), *[pa.array(x, pa.int64()) for x in found.values()]], ["doc_id", *found]
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(rows, LEDGER)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def audited(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with their ledger beside them, written once, and the name of its bits' column."""
    names = fresh(docs, *MEASURES, "failed_bits")
    schema = StructType([*docs.schema, *[StructField(n, LongType()) for n in names]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                found = measure(chunk)
                yield pa.RecordBatch.from_arrays(
                    [*chunk.columns, *[pa.array(x, pa.int64()) for x in found.values()]], [*chunk.schema.names, *names]
                )

    return written(docs.mapInArrow(rows, schema), "audited"), names[-1]


def keep(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with all their columns: a filter on the written ledger."""
    rows, bits = audited(docs)
    return rows.where(F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects."""
    mask = mask_of(POLICIES[policy])
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    names = list(RULES)
    counts = []
    for rule in POLICIES[policy]:
        bit = 1 << names.index(rule)
        counts += [
            F.sum((bits.bitwiseAND(F.lit(bit)) != 0).cast("bigint")).alias(f"{rule}__failed"),
            F.sum((bits == bit).cast("bigint")).alias(f"{rule}__alone"),
        ]
    one = entries.agg(*counts)
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.coalesce(f"{r}__failed", F.lit(0)).alias("failed"), F.coalesce(f"{r}__alone", F.lit(0)).alias("only_this"))
            for r in POLICIES[policy]
        ]
    )
    return one.select(F.inline(rows))


def only_rule(policy: str) -> Column:
    """The rule that alone rejects a ledger row under a policy; null if none or several do."""
    bits, found = F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))), F.lit(None).cast("string")
    for rule in POLICIES[policy]:
        found = F.when(bits == mask_of((rule,)), rule).otherwise(found)
    return found


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with every policy's verdict and what leaving out a rule would bring back.

    ``base_failed`` and ``kept`` are the verdicts of the base rules and of both base and ``policy``, ``passed_*``
    those of each version. ``only_rule`` is the one rule that rejects a document under ``policy``, and
    ``only_rule_documents`` how many documents that rule alone rejects. All come from one written ledger.
    """
    entries = written(ledger(docs), "rule_ledger")
    alone = ablations(entries, policy).select(F.col("rule").alias("only_rule"), F.col("only_this").alias("only_rule_documents"))
    judged = entries.withColumns(
        {
            "base_failed": ~passes("base"), "kept": passes("base") & passes(policy),
            **{f"passed_{name}": passes(name) for name in POLICIES}, "only_rule": only_rule(policy),
        }
    )
    # a row for each rule
    return judged.join(F.broadcast(alone), "only_rule", "left").select(*judged.columns, "only_rule_documents")
