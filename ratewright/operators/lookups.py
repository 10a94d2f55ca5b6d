"""Per-book lookups: descriptions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions import zero_vector
from .keys import keep_first, keep_last
from .skew import HeavyKeys, salted_join


def descriptions_of(descriptions: DataFrame, rows: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """All description rows of the books that occur in `rows`; copies of one book stay. `heavy` is of `descriptions`."""
    books = rows.select(N.BOOK).distinct()
    spread = [c for c in descriptions.columns if c not in (N.BOOK, N.DESCRIPTION)]
    return salted_join(descriptions, books, N.BOOK, "left_semi", spread, heavy=heavy)


def last_descriptions(descriptions: DataFrame, order: str = N.ROW_ORDER) -> DataFrame:
    """One text per book, the last in file order; a missing text is empty."""
    kept = keep_last(descriptions, [N.BOOK], order, grouped=True)
    return kept.select(N.BOOK, F.coalesce(N.DESCRIPTION, F.lit("")).alias(N.DESCRIPTION))


def first_descriptions(descriptions: DataFrame, order: str = N.ROW_ORDER) -> DataFrame:
    """One text per book, the first in file order; a missing text is empty."""
    kept = keep_first(descriptions, [N.BOOK], order, grouped=True)
    return kept.select(N.BOOK, F.coalesce(N.DESCRIPTION, F.lit("")).alias(N.DESCRIPTION))


def _spread(rows: DataFrame) -> list[str]:
    return [c for c in (N.USER, N.TIMESTAMP) if c in rows.columns]


def attach_descriptions(
    rows: DataFrame, descriptions: DataFrame, heavy: HeavyKeys, order: str = N.ROW_ORDER
) -> DataFrame:
    """The description of each row's book; a book without one has the empty text."""
    texts = last_descriptions(descriptions, order)
    joined = salted_join(rows, texts, N.BOOK, "left", _spread(rows), heavy=heavy)
    return joined.withColumn(N.DESCRIPTION, F.coalesce(N.DESCRIPTION, F.lit("")))


def attach_embeddings(
    rows: DataFrame, embeddings: DataFrame, heavy: HeavyKeys, dim: int = N.EMBEDDING_DIM
) -> DataFrame:
    """The embedding of each row's book; a book without one has the zero vector. `embeddings` has one row per book."""
    joined = salted_join(
        rows, embeddings.select(N.BOOK, N.EMBEDDING), N.BOOK, "left", _spread(rows), heavy=heavy
    )
    return joined.withColumn(N.EMBEDDING, F.coalesce(N.EMBEDDING, zero_vector(dim)))
