"""From feature columns to the learner's input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N
from ..session import stored
from .skew import HeavyKeys, salted_join

FEATURES = "features"


def index_name(column: str) -> str:
    return f"{column}_index"


def feature_columns(rows: DataFrame) -> list[str]:
    """Columns that describe a row: not its origin, target, prediction or time, and no free text.

    The read flag is left out as well: it is one in every train row and unknown in every test row.
    """
    dropped = {*N.NOT_FEATURES, *N.FREE_TEXT, N.HAS_READ}
    text = {f.name for f in rows.schema.fields if f.dataType.typeName() in {"string", "varchar", "char"}}
    return [c for c in rows.columns if c not in dropped and (c not in text or c in N.TEXT_CATEGORIES)]


def feature_matrix(rows: DataFrame) -> DataFrame:
    return rows.select(*feature_columns(rows))


def category_levels(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A written table of the levels of the text categories, numbered from 0 in alphabetical order per column:
    `(column, level, number)`.

    Levels are ranged by column and level into sorted partitions; a level's number is its place in its partition plus the
    levels of its column in the partitions before. The driver sees no level, so there may be any number of them.
    """
    columns = list(columns or [c for c in N.TEXT_CATEGORIES if c in rows.columns])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns]
    found = rows.select(F.inline(F.array(*entries))).filter(F.col("level").isNotNull()).distinct()
    ranged = found.repartitionByRange("column", "level").sortWithinPartitions("column", "level")
    # After the sort, the lower bits of this id count the rows of a partition in order.
    placed = ranged.withColumn("part", F.spark_partition_id()).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    )
    placed = stored(placed, "levels")
    runs = placed.groupBy("column", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = runs.select("column", "part", offset.alias("offset"))
    numbered = placed.join(offsets, ["column", "part"]).withColumn("number", F.col("place") + F.col("offset"))
    return stored(numbered.select("column", "level", "number"), "level-numbers")


def index_categories(
    rows: DataFrame, levels: DataFrame, heavy: HeavyKeys, columns: Sequence[str] | None = None
) -> DataFrame:
    """`rows` with the number of each category's level as `<column>_index`; a missing level and one that `levels` does not
    have get the number of levels. Frequent levels are split by `heavy`, which counts the same columns."""
    for column in columns or [c for c in N.TEXT_CATEGORIES if c in rows.columns]:
        own = levels.filter(F.col("column") == column)
        numbers = own.select(F.col("level").alias(column), F.col("number").alias(index_name(column)))
        joined = salted_join(rows, numbers, column, "left", N.PAIR, heavy=heavy)
        index = F.coalesce(index_name(column), own.agg(F.count("*")).scalar())
        rows = joined.withColumn(index_name(column), index.cast("double"))
    return rows


def vectors_ready(rows: DataFrame) -> DataFrame:
    """Turn the embedding, an array, into a vector column."""
    if N.EMBEDDING in rows.columns and rows.schema[N.EMBEDDING].dataType.typeName() == "array":
        return rows.withColumn(N.EMBEDDING, array_to_vector(F.col(N.EMBEDDING)))
    return rows


def assembler(columns: Sequence[str]) -> VectorAssembler:
    """Vector assembly of feature columns whose categories are indexed.

    An index becomes a plain number here: naming it a category would tie the learner's bins to the number of publishers.
    """
    inputs = [index_name(c) if c in N.TEXT_CATEGORIES else c for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error")
