"""The corpus pipeline: from documents to packed sequences.

STAGES lists its stages as (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps. All but
the last return the columns of documents. `run` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import line_dedup, mixing, packing, quality, simhash
from ratewright.llm.names import fresh
from ratewright.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    stats, kept = fresh(docs, "stats", "kept")
    rated = stored(docs.withColumn(stats, quality.rule_stats("text")), "rated")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(rated, labels, "doc_id", stats, kept).filter(F.col(kept)).select(*docs.columns)


def line_dedup_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars follows the text."""
    cleaned = line_dedup.drop_site_lines(docs, host="source", text="text")
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    path = public_tokenizers.path
    return packing.pack_documents(
        docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_by_source),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

# Hash draws, fingerprints and token ids are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
