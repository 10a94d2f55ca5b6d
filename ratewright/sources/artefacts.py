"""Reusable text artefacts as Parquet tables: the fitted vocabulary and the cache of book embeddings.

An artefact lives in a folder named by a version that the caller gives, so changed data never meets an old artefact.

Tables that belong together are published: each run writes them into a folder of its own and marks it at the end. Readers
take the run that was marked first, so an interrupted run is never read, and of runs at the same time all readers take one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names as N


def versioned(folder: str, kind: str, version: str) -> str:
    return f"{folder.rstrip('/')}/{kind}/version={version}"


def save_table(table: DataFrame, path: str) -> None:
    """Write an artefact; a version that exists already is an error."""
    table.write.mode("errorifexists").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


DONE = "_done"


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """Write tables by name as one run of the version at `path`, and mark it when all of them are there."""
    run = f"{path}/run-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/{DONE}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(marker)


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the run of this version that was marked first (of equal times the smaller name), if there is one."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run-*/{DONE}")
    marks = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    runs = sorted((m.getModificationTime(), m.getPath().getParent().toString()) for m in marks)
    return runs[0][1] if runs else None


def append_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select(N.BOOK, N.EMBEDDING).write.mode("append").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """One embedding per book. A repeated append or two runs at once may store a book twice; the smallest array stays."""
    return spark.read.parquet(path).groupBy(N.BOOK).agg(F.min(N.EMBEDDING).alias(N.EMBEDDING))
