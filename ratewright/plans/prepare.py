"""From raw tables to stored features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from ..functions import zero_vector
from ..operators import aggregates, embeddings, lookups, merge, missing, tfidf
from ..operators.skew import find_heavy
from ..session import stored
from ..sources import append_embeddings, load_table, publish, published, read_embeddings, versioned, write_features


@dataclass(frozen=True)
class TextSettings:
    """How texts become features. `version` names the vocabulary and the embeddings of one state of the data.

    `text_tasks` spreads the descriptions over so many tasks first, for scans of few files that cannot be split; by default
    they stay as they were read.
    """

    version: str
    artefacts: str
    max_features: int = N.TFIDF_MAX_FEATURES
    min_df: int = N.TFIDF_MIN_DF
    max_df: float = N.TFIDF_MAX_DF
    embedding_dim: int = N.EMBEDDING_DIM
    make_encoder: Callable[[], embeddings.Encoder] | None = None
    encoder_tasks: int | None = None
    text_tasks: int | None = None


@dataclass(frozen=True)
class Prepared:
    """What was stored: rows per source and columns, and the train log's rows before and after those without a rating
    went. The numbers are observed on the writes."""

    folder: str
    rows: dict[str, int]
    n_features: int
    log_rows: dict[str, int]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        load_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def fitted_vocabulary(
    spark: SparkSession, descriptions: DataFrame, train: DataFrame, text: TextSettings
) -> DataFrame:
    """The published vocabulary of this version, fitted on the descriptions of train books if there is none yet.

    Its settings are published with it; asking for the same version with others is an error.
    """
    path = versioned(text.artefacts, "vocabulary", text.version)
    wanted = (text.max_features, text.min_df, float(text.max_df))
    run = published(spark, path)
    if run is None:
        fit_on = lookups.descriptions_of(descriptions, train, find_heavy(descriptions, [N.BOOK]))
        vocabulary = tfidf.fit_vocabulary(fit_on, text.max_features, text.min_df, text.max_df)
        settings = spark.createDataFrame([wanted], "max_features INT, min_df INT, max_df DOUBLE")
        publish({"settings": settings, "vocabulary": vocabulary}, path)
        run = published(spark, path)
    found = tuple(load_table(spark, f"{run}/settings").first())
    if found != wanted:
        raise ValueError(f"version {text.version} has (max_features, min_df, max_df) = {found}, not {wanted}")
    return load_table(spark, f"{run}/vocabulary")


def cached_embeddings(spark: SparkSession, descriptions: DataFrame, text: TextSettings) -> DataFrame | None:
    """The embeddings of this version; books that the cache lacks are encoded and appended first."""
    path = versioned(text.artefacts, "embeddings", text.version)
    if text.make_encoder is not None:
        texts = lookups.first_descriptions(descriptions)
        if _exists(spark, path):
            texts = embeddings.books_to_encode(texts, read_embeddings(spark, path))
        append_embeddings(embeddings.encode_books(texts, text.make_encoder, tasks=text.encoder_tasks), path)
    return read_embeddings(spark, path) if _exists(spark, path) else None


def book_vectors(
    rows: DataFrame, descriptions: DataFrame, vocabulary: DataFrame, cache: DataFrame | None, text: TextSettings
) -> DataFrame:
    """One line per book of `rows` with its sparse TF-IDF vector and, if there is a cache, its embedding."""
    books = rows.select(N.BOOK).distinct()
    texts = books.join(lookups.last_descriptions(descriptions), N.BOOK, "left")
    vectors = tfidf.tfidf_vectors(texts, vocabulary, text.max_features)
    if cache is None:
        return vectors
    joined = vectors.join(cache, N.BOOK, "left")
    return joined.withColumn(N.EMBEDDING, F.coalesce(N.EMBEDDING, zero_vector(text.embedding_dim)))


def filled_rows(log: DataFrame, users: DataFrame, books: DataFrame, book_genres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged rows of `log` with their genre counts, as stored, and filled.

    `log` is what `union_sources` gives, stored: heavy keys are counted in it before it is joined. The merged rows are
    written once: the fill values need a pass over them before the filled rows can be made, and reading two columns back
    is cheaper than joining twice.
    """
    heavy = find_heavy(log, N.PAIR)
    merged = merge.merge_interactions(log, users, books, heavy)
    rows = stored(aggregates.attach_genre_counts(merged, book_genres, heavy), "merged", [N.SOURCE])
    return rows, missing.fill_missing(rows, rows.filter(F.col(N.SOURCE) == N.TRAIN))


def prepare(spark: SparkSession, tables: dict[str, DataFrame], folder: str, text: TextSettings) -> Prepared:
    """Merge, count genres, fill, add text vectors, and store the features below `folder`.

    Rating aggregates are left to training and prediction, which know the rows they may use.
    """
    descriptions = tables["book_descriptions"]
    if text.text_tasks is not None:
        descriptions = descriptions.repartition(text.text_tasks)
    log_rows, kept_rows = Observation(), Observation()
    log = stored(merge.union_sources(merge.keep_rated(tables["train"], log_rows), tables["test"]), "log")
    rows, filled = filled_rows(log, tables["users"], tables["books"], tables["book_genres"])
    vocabulary = fitted_vocabulary(spark, descriptions, rows.filter(F.col(N.SOURCE) == N.TRAIN), text)
    cache = cached_embeddings(spark, descriptions, text)
    vectors = book_vectors(rows, descriptions, vocabulary, cache, text)
    sizes = [F.count_if(F.col(N.SOURCE) == s).alias(s) for s in (N.TRAIN, N.TEST)]
    write_features(filled.observe(kept_rows, *sizes), vectors, folder)
    return Prepared(folder, kept_rows.get, len(filled.columns) + len(vectors.columns) - 1, log_rows.get)
