"""Small helpers that the operators share."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession

from orderflow.sources.shared_folder import stage

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this library where it lies on the driver, if it isn't installed."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (paths, here) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back: this cuts lineage."""
    return stage(df, name)


def parts(total: float, each: float) -> int:
    """How many partitions hold ``total`` at about ``each``."""
    return max(1, math.ceil((total or 0) / each))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Variants of ``names`` that are no columns of ``df``, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; every machine of a cluster has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)
