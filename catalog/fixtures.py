"""The engine's input tables, derived from the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import names as N
from ratewright.functions import time_literal
from ratewright.operators import formation, merge
from ratewright.operators.skew import HeavyKeys, find_heavy
from ratewright.session import stored

BOUNDARY = datetime(2000, 12, 31)


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def unfiltered_log(self) -> DataFrame:
        """All interactions with the rating that planned items would carry, and the line number."""
        line, order = self.read("lineitem"), self.read("orders")
        return line.join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias(N.USER),
            F.col("l_partkey").alias(N.BOOK),
            F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias(N.HAS_READ),
            (F.col("l_quantity") / F.lit(5.0)).alias(N.RATING),
            F.col("l_shipdate").alias(N.TIMESTAMP),
            "l_linenumber",
        )

    @cached_property
    def log(self) -> DataFrame:
        rating = F.when(F.col(N.HAS_READ) == 0, F.lit(0.0)).otherwise(F.col(N.RATING))
        return self.unfiltered_log.select(N.USER, N.BOOK, N.HAS_READ, rating.alias(N.RATING), N.TIMESTAMP)

    @staticmethod
    def in_train() -> Column:
        return (F.col(N.TIMESTAMP) <= time_literal(BOUNDARY)) & (F.col(N.BOOK) % 41 != 7)

    @staticmethod
    def in_test() -> Column:
        return F.col(N.TIMESTAMP) > time_literal(BOUNDARY)

    @cached_property
    def train(self) -> DataFrame:
        return self.log.filter(self.in_train())

    @cached_property
    def rated(self) -> DataFrame:
        return self.train.filter(formation.is_read())

    @cached_property
    def formed_solution(self) -> DataFrame:
        stage = F.when(F.col(N.USER) % 2 == 0, N.PUBLIC).otherwise(N.PRIVATE)
        return formation.form_solution(self.log, self.in_train(), self.in_test(), stage)

    @cached_property
    def solution(self) -> DataFrame:
        """The solution as the stored table that it is for its users: forming it anew for every use scans the log."""
        return stored(self.formed_solution, "solution")

    @cached_property
    def test(self) -> DataFrame:
        return self.solution.select(*N.PAIR)

    @cached_property
    def rated_log(self) -> DataFrame:
        """Rated train rows and test rows, stored: heavy keys are counted in them before they are joined."""
        return stored(merge.union_sources(self.rated, self.test), "log")

    @cached_property
    def heavy(self) -> HeavyKeys:
        return find_heavy(self.rated_log, N.PAIR)

    @cached_property
    def users(self) -> DataFrame:
        nation = F.col("c_nationkey") % 3
        return (
            self.read("customer")
            .filter(F.col("c_custkey") % 53 != 5)
            .select(
                F.col("c_custkey").alias(N.USER),
                F.when(nation == 1, "1").when(nation == 2, "2").alias(N.GENDER),
                F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 125.0).cast("double") + 12.0).alias(N.AGE),
            )
        )

    @cached_property
    def books(self) -> DataFrame:
        part = self.read("part")
        key, size = F.col("p_partkey"), F.col("p_size")
        first = part.filter(key % 43 != 11).select(
            key.alias(N.BOOK),
            F.col("p_name").alias(N.TITLE),
            F.substring("p_brand", 7, 10).cast("int").alias(N.AUTHOR),
            F.col("p_brand").alias(N.AUTHOR_NAME),
            F.when(size != 13, (size + 1970).cast("double")).alias(N.YEAR),
            F.col("p_type").alias(N.LANGUAGE),
            F.when(size % 10 != 9, (size % 7).cast("string")).alias(N.PUBLISHER),
            F.when(key % 17 != 4, (key % 100).cast("double") / 10.0).alias(N.AVG_RATING),
            F.lit(0).alias(N.ROW_ORDER),
        )
        second = part.filter(key % 47 == 3).select(
            key.alias(N.BOOK),
            F.col("p_name").alias(N.TITLE),
            F.lit(99).alias(N.AUTHOR),
            F.lit("second copy").alias(N.AUTHOR_NAME),
            F.lit(1900.0).alias(N.YEAR),
            F.col("p_type").alias(N.LANGUAGE),
            F.lit("9").alias(N.PUBLISHER),
            F.lit(1.0).alias(N.AVG_RATING),
            F.lit(1).alias(N.ROW_ORDER),
        )
        return first.unionByName(second)

    @cached_property
    def book_genres(self) -> DataFrame:
        return (
            self.read("lineitem")
            .filter(F.col("l_partkey") % 19 != 6)
            .select(F.col("l_partkey").alias(N.BOOK), (F.col("l_suppkey") % 12).cast("int").alias(N.GENRE))
            .distinct()
        )

    @cached_property
    def genres(self) -> DataFrame:
        sizes = formation.genre_sizes(self.book_genres)
        return sizes.select(
            N.GENRE, F.concat(F.lit("genre_"), F.col(N.GENRE).cast("string")).alias(N.GENRE_NAME), N.BOOKS_COUNT
        )

    @cached_property
    def descriptions(self) -> DataFrame:
        docs, key = self.read("documents"), F.col("doc_id")
        first = docs.select(
            key.alias(N.BOOK), F.when(key % 29 != 0, F.col("text")).alias(N.DESCRIPTION), F.lit(0).alias(N.ROW_ORDER)
        )
        second = docs.filter(key % 31 == 2).select(
            key.alias(N.BOOK),
            F.concat("text", F.lit(" second copy")).alias(N.DESCRIPTION),
            F.lit(1).alias(N.ROW_ORDER),
        )
        return first.unionByName(second)

    @cached_property
    def heavy_descriptions(self) -> HeavyKeys:
        return find_heavy(self.descriptions, [N.BOOK])

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias(N.BOOK), N.EMBEDDING)
