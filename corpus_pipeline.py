"""From raw documents to packed training windows, stage by stage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. What
it returns is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderflow.llm import minhash_dedup, mixing, packing, quality_classifier, quality_rules
from orderflow.llm.tables import documents, importable, tokenizer_file, written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    importable(spark)
    return quality_classifier.keep(docs)


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    importable(spark)
    return quality_rules.keep(docs, "v2")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    importable(spark)
    return minhash_dedup.keep(docs, words_each=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part is cut to those words."""
    importable(spark)
    return mixing.mixed_copies(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens: a row for each piece of a document, with its token ids.

    The ids of a sequence's pieces, in the order of their offsets, are the window. Documents that the mix takes
    several times, some of them cut, have a ``row`` for each time.
    """
    importable(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0, with_ids=True)


STAGES = [
    ("quality_classifier", accept_quality),
    ("quality_rules", pass_rules),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained scorer, a schedule and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
