"""Rated interactions, union of train and test, and the metadata of users and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import names as N
from .formation import is_read
from .keys import keep_first
from .skew import HeavyKeys, salted_join

SPREAD = [N.USER, N.BOOK, N.TIMESTAMP]


def keep_rated(log: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Interactions with a rating. `counts` reports the rows before and after, filled by whatever action runs the plan.

    Observing keeps the filter above the scan's output, so it is off unless asked for.
    """
    if counts is not None:
        log = log.observe(counts, F.count("*").alias("before"), F.count_if(is_read()).alias("after"))
    return log.filter(is_read())


def union_sources(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows tagged by origin; columns that test rows lack are null there."""
    tagged = train.withColumn(N.SOURCE, F.lit(N.TRAIN))
    return tagged.unionByName(test.withColumn(N.SOURCE, F.lit(N.TEST)), allowMissingColumns=True)


def attach_users(rows: DataFrame, users: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """User metadata, where known. A repeated user repeats the rows."""
    return salted_join(rows, users, N.USER, "left", SPREAD, heavy=heavy)


def attach_books(rows: DataFrame, books: DataFrame, heavy: HeavyKeys, order: str = N.ROW_ORDER) -> DataFrame:
    """Book metadata, where known, from the first row of each book."""
    first = keep_first(books, [N.BOOK], order).drop(order)
    return salted_join(rows, first, N.BOOK, "left", SPREAD, heavy=heavy)


def merge_interactions(
    rows: DataFrame, users: DataFrame, books: DataFrame, heavy: HeavyKeys, order: str = N.ROW_ORDER
) -> DataFrame:
    """The rows of `union_sources` with the metadata of their user and book."""
    return attach_books(attach_users(rows, users, heavy), books, heavy, order)
