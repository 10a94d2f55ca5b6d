"""The registered queries of this subpackage: each takes the session and the folder of driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import (
    alignment, bm25, chat, line_dedup, merkle, mixing, packing, quality, simhash, token_counts, token_output, toxicity,
    winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_output.pack_ids(docs, BYTE_BPE, BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op2_top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, taken as a query."""
    docs = table(spark, folder, "documents")
    return bm25.search(docs, docs.filter(F.col("doc_id") % 100 == 0))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rated = stored(docs.select("doc_id", quality.rule_stats("text").alias("stats")), "rule-stats")
    judged = quality.judge(rated, table(spark, folder, "labels"), "doc_id", "stats", "kept")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id", *[F.col(f"stats.{n}").alias(n) for n in names], quality.base_failed("stats").alias("base_failed"), "kept"
    )


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_site_lines(docs, host="source", dropped="n_dropped")


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_texts(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), WORD_BPE)


@query
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts consist of control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], rows.schema)
    digests = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    return digests.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *digests.columns[1:])


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, folder, "documents"))


@query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, BYTE_BPE, BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op11_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return winnowing.find_benchmark(docs, table(spark, folder, "benchmark"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every second document (by the checksum of its id) is checked with its line feeds taken out."""
    docs = table(spark, folder, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify_rows(docs, changed={"text": without})


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment.align_tokenizers(docs, BYTE_BPE, PIECE_BPE, BYTE_RANKS, public_tokenizers.PATTERN)
