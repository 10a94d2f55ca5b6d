"""Rating aggregates per user, book and author, genre counts, and their attachment to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from .merge import SPREAD
from .skew import HeavyKeys, salted_join


def rating_stats(train: DataFrame, key: str, mean: str, count: str | None = None) -> DataFrame:
    """Mean, and on request number, of the ratings of each key. Rows without a key form no group."""
    values = [F.avg(N.RATING).alias(mean)]
    if count:
        values.append(F.count(N.RATING).alias(count))
    return train.filter(F.col(key).isNotNull()).groupBy(key).agg(*values)


def user_stats(train: DataFrame) -> DataFrame:
    return rating_stats(train, N.USER, N.USER_MEAN, N.USER_COUNT)


def book_stats(train: DataFrame) -> DataFrame:
    return rating_stats(train, N.BOOK, N.BOOK_MEAN, N.BOOK_COUNT)


def author_stats(train: DataFrame) -> DataFrame:
    return rating_stats(train, N.AUTHOR, N.AUTHOR_MEAN)


def genre_counts(book_genres: DataFrame) -> DataFrame:
    """Genre entries per book; entries without a genre do not count, repeated entries do."""
    keyed = book_genres.filter(F.col(N.BOOK).isNotNull())
    return keyed.groupBy(N.BOOK).agg(F.count(N.GENRE).alias(N.GENRES_COUNT))


def _spread(rows: DataFrame) -> list[str]:
    return [c for c in SPREAD if c in rows.columns]


def attach_rating_stats(rows: DataFrame, train: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """Attach the aggregates of `train` to `rows`, which may be other rows than those aggregated.

    `train` is read once per key and should be a stored table.
    """
    spread = _spread(rows)
    for key, stats in ((N.USER, user_stats), (N.BOOK, book_stats), (N.AUTHOR, author_stats)):
        rows = salted_join(rows, stats(train), key, "left", spread, heavy=heavy)
    return rows


def attach_genre_counts(rows: DataFrame, book_genres: DataFrame, heavy: HeavyKeys) -> DataFrame:
    return salted_join(rows, genre_counts(book_genres), N.BOOK, "left", _spread(rows), heavy=heavy)
