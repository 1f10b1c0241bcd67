"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.alignment import aligned_documents
from orderflow.llm.clustering import cluster
from orderflow.llm.embedding_dedup import near_vectors
from orderflow.llm.minhash_dedup import near_duplicates
from orderflow.llm.mixing import mixed_documents
from orderflow.llm.neighbours import neighbours
from orderflow.llm.packing import pack
from orderflow.llm.quality_classifier import quality
from orderflow.llm.quality_rules import quality_rules
from orderflow.llm.sharding import kd_shards
from orderflow.llm.tables import documents, table, tokenizer_file
from orderflow.llm.toxicity import toxicity
from orderflow.llm.warc import warc_round_trip
from orderflow.llm.wavelet import wavelet_shards

Query = Callable[[SparkSession, str], DataFrame]


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), shards=16)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.98)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0, with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc_round_trip(table(spark, sf_dir, "pages"), least_bytes=0).select(*columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words_each=2, similarity=0.8)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(documents(spark, sf_dir))


def op10_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_shards(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, size=64, scale=64, seed=1).drop("measured_share")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 100 == 0, k=10)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash": op8_minhash,
    "op9_mixing": op9_mixing,
    "op10_wavelet": op10_wavelet,
    "op11_centroids": op11_centroids,
    "op12_neighbours": op12_neighbours,
    "op13_alignment": op13_alignment,
}
