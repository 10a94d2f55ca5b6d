"""How the train and test tables are made from one interaction log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions import time_literal


def is_read() -> Column:
    return F.col(N.HAS_READ) == 1


def is_planned() -> Column:
    return F.col(N.HAS_READ) == 0


def time_chunks(log: DataFrame, boundary: datetime) -> tuple[DataFrame, DataFrame]:
    """Two consecutive chunks; the boundary itself belongs to the first."""
    cut = time_literal(boundary)
    return log.filter(F.col(N.TIMESTAMP) <= cut), log.filter(F.col(N.TIMESTAMP) > cut)


def drop_anomalies(log: DataFrame) -> DataFrame:
    """Drop planned items that carry a rating. Rows with a missing flag or rating are no such anomaly and stay."""
    return log.filter(~F.coalesce(is_planned() & (F.col(N.RATING) > 0), F.lit(False)))


def _latest(when: Column) -> Column:
    """The latest of the rows where `when` holds. Equal times go to the larger book, then the larger rating."""
    return F.max(F.when(when, F.struct(N.TIMESTAMP, N.BOOK, N.RATING)))


def last_read(log: DataFrame) -> DataFrame:
    """Each user's latest read interaction."""
    picked = log.filter(is_read()).groupBy(N.USER).agg(_latest(F.lit(True)).alias("last"))
    return picked.select(N.USER, "last.book_id", "last.rating", "last.timestamp")


def _is_warm(reads: Column, planned: Column, min_reads: int, min_planned: int) -> Column:
    return (reads >= min_reads) | (planned >= min_planned)


def warm_users(train_log: DataFrame, min_reads: int = 1, min_planned: int = 3) -> DataFrame:
    """Users with enough read or enough planned items."""
    counts = train_log.groupBy(N.USER).agg(
        F.count_if(is_read()).alias("n_read"), F.count_if(is_planned()).alias("n_planned")
    )
    return counts.filter(_is_warm(F.col("n_read"), F.col("n_planned"), min_reads, min_planned)).select(N.USER)


def form_solution(
    log: DataFrame, in_train: Column, in_test: Column, stage: Column, min_reads: int = 1, min_planned: int = 3
) -> DataFrame:
    """The solution table: the last read item after the cut of every user who is warm before it.

    Both rules look at the same user, so one aggregation over the log answers them: one scan, one shuffle, and no
    join of the log with itself.
    """
    users = log.groupBy(N.USER).agg(
        _latest(in_test & is_read()).alias("last"),
        F.count_if(in_train & is_read()).alias("n_read"),
        F.count_if(in_train & is_planned()).alias("n_planned"),
    )
    warm = _is_warm(F.col("n_read"), F.col("n_planned"), min_reads, min_planned)
    return users.filter(warm & F.col("last").isNotNull()).select(
        N.USER, "last.book_id", "last.rating", stage.alias(N.STAGE)
    )


def book_average(log: DataFrame, include_planned: bool = False) -> DataFrame:
    """Average rating per book over the whole log; placeholder zeros of planned items count only on request."""
    rated = log if include_planned else log.filter(is_read())
    return rated.groupBy(N.BOOK).agg(F.avg(N.RATING).alias(N.AVG_RATING))


def genre_sizes(book_genres: DataFrame) -> DataFrame:
    """Number of books per genre. The table is a set of pairs, so repeated pairs are merged first."""
    pairs = book_genres.filter(F.col(N.BOOK).isNotNull()).select(N.BOOK, N.GENRE).distinct()
    return pairs.groupBy(N.GENRE).agg(F.count("*").alias(N.BOOKS_COUNT))


def keep_warm(candidates: DataFrame, warm: DataFrame) -> DataFrame:
    """Rows of users in `warm`. Candidates are last reads, one per user, so no key is heavy."""
    return candidates.join(warm, N.USER, "left_semi")
