"""Parquet store of prepared features.

Two tables: `rows` holds one line per interaction with its scalar features, partitioned by source so that the train and
test halves are a partition prune; `books` holds one line per book with its text vectors. The vectors are many times wider
than a row and equal for all rows of a book, so they are stored once and joined where a model needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import names as N


def write_features(rows: DataFrame, book_vectors: DataFrame | None, folder: str) -> None:
    base = folder.rstrip("/")
    rows.write.mode("overwrite").option("compression", "snappy").partitionBy(N.SOURCE).parquet(f"{base}/rows")
    if book_vectors is not None:
        book_vectors.write.mode("overwrite").option("compression", "snappy").parquet(f"{base}/books")


def read_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The `rows` and `books` tables; Spark raises `AnalysisException` when the features were not prepared."""
    base = folder.rstrip("/")
    return spark.read.parquet(f"{base}/rows"), spark.read.parquet(f"{base}/books")
