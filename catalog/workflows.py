"""Queries that go through files or fit a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright import names as N
from ratewright.functions import strict_double
from ratewright.operators import boosting, lookups, matrix, metrics, temporal, tfidf
from ratewright.operators.skew import find_heavy
from ratewright.plans import predict, prepare, train
from ratewright.plans.prepare import TextSettings
from ratewright.plans.train import PLACE, in_fixed_order, rows_per_partition, with_place
from ratewright.schemas import NULL_TOKENS
from ratewright.session import fresh_path, stored
from ratewright.sources import (
    append_embeddings,
    load_table,
    read_features,
    save_table,
    scan,
    versioned,
    write_submission,
)

from .fixtures import Fixtures

WORKFLOWS: dict[str, Callable[[Fixtures], DataFrame]] = {}


def workflow(run: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    WORKFLOWS[run.__name__] = run
    return run


def hashing_encoder(dim: int = 2, digest: str = "md5") -> Callable[[], Callable]:
    """A stand-in for a language model: the vector of a token is the first bytes of its hash."""

    def make():
        import hashlib
        import re

        import numpy as np

        vectors = {}

        def vector(word):
            if word not in vectors:
                vectors[word] = list(hashlib.new(digest, word.encode()).digest()[:dim])
            return vectors[word]

        def encode(texts):
            words = [re.findall(r"\w{2,}", t.lower()) for t in texts]
            width = max(1, *(len(w) for w in words))
            hidden = np.zeros((len(texts), width, dim))
            mask = np.zeros((len(texts), width))
            for i, row in enumerate(words):
                mask[i, : len(row)] = 1
                for j, word in enumerate(row):
                    hidden[i, j] = vector(word)
            return hidden, mask

        return encode

    return make


def baseline(x: Fixtures) -> DataFrame:
    return metrics.mean_baseline(x.test, x.rated, find_heavy(x.test, [N.BOOK]))


def _write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


@workflow
def scan_csv_roundtrip(x: Fixtures) -> DataFrame:
    path = fresh_path(x.spark, "train-csv")
    _write_csv(x.train, path)
    return scan(x.spark, "train", path)


def _with_null_tokens(df: DataFrame) -> DataFrame:
    """All columns as text, missing values written as one or another of the tokens that stand for them."""
    choice = F.pmod(F.xxhash64(*df.columns), F.lit(len(NULL_TOKENS))).cast("int")
    token = F.get(F.array(*map(F.lit, NULL_TOKENS)), choice)
    return df.select(*[F.coalesce(F.col(c).cast("string"), token).alias(c) for c in df.columns])


def _scanned(x: Fixtures, table: str, df: DataFrame) -> DataFrame:
    path = fresh_path(x.spark, f"{table}-csv")
    _write_csv(_with_null_tokens(df), path)
    return scan(x.spark, table, path)


@workflow
def scan_test_roundtrip(x: Fixtures) -> DataFrame:
    return _scanned(x, "test", x.test)


@workflow
def scan_users_roundtrip(x: Fixtures) -> DataFrame:
    return _scanned(x, "users", x.users)


@workflow
def scan_book_genres_roundtrip(x: Fixtures) -> DataFrame:
    return _scanned(x, "book_genres", x.book_genres)


@workflow
def scan_genres_roundtrip(x: Fixtures) -> DataFrame:
    return _scanned(x, "genres", x.genres)


@workflow
def scan_solution_roundtrip(x: Fixtures) -> DataFrame:
    return _scanned(x, "solution", x.solution).withColumn(N.RATING, strict_double(F.col(N.RATING)))


@workflow
def scan_books_roundtrip(x: Fixtures) -> DataFrame:
    path = fresh_path(x.spark, "books-csv")
    columns = [f for f in x.books.columns if f != N.ROW_ORDER]
    _write_csv(x.books.select(*columns), path)
    return scan(x.spark, "books", path).select(*columns)


@workflow
def scan_descriptions_roundtrip(x: Fixtures) -> DataFrame:
    path = fresh_path(x.spark, "descriptions-csv")
    _write_csv(x.descriptions.select(N.BOOK, N.DESCRIPTION), path)
    return scan(x.spark, "book_descriptions", path).select(
        N.BOOK, F.length(N.DESCRIPTION).cast("bigint").alias("n_chars"), F.md5(N.DESCRIPTION).alias("description_md5")
    )


@workflow
def submission(x: Fixtures) -> DataFrame:
    """A submission written as CSV and scanned as the checks would."""
    path = fresh_path(x.spark, "submission")
    write_submission(baseline(x), path)
    back = scan(x.spark, "submission", path)
    return back.select(*N.PAIR, F.round(strict_double(F.col(N.PREDICTION)), 6).alias(N.PREDICTION))


@workflow
def vocabulary_roundtrip(x: Fixtures) -> DataFrame:
    path = fresh_path(x.spark, "vocabulary")
    save_table(tfidf.fit_vocabulary(lookups.descriptions_of(x.descriptions, x.rated, x.heavy_descriptions)), path)
    return load_table(x.spark, path).select("term", "idx", F.round("idf", 6).alias("idf"))


DIM = 64


def prepared_features(x: Fixtures) -> str:
    """Features of the fixture tables with the stored embeddings as the cache; returns their folder."""
    folder = fresh_path(x.spark, "features")
    tables = {
        "train": x.train, "test": x.test, "users": x.users, "books": x.books,
        "book_genres": x.book_genres, "book_descriptions": x.descriptions,
    }
    text = TextSettings(version="1", artefacts=fresh_path(x.spark, "artefacts"), embedding_dim=DIM)
    append_embeddings(x.embeddings, versioned(text.artefacts, "embeddings", text.version))
    prepare(x.spark, tables, folder, text)
    return folder


@workflow
def features_parquet_roundtrip(x: Fixtures) -> DataFrame:
    rows, _ = read_features(x.spark, prepared_features(x))
    return rows.select(
        *[
            F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


@workflow
def book_vectors(x: Fixtures) -> DataFrame:
    """The stored vectors of each book in long form: its TF-IDF weights and the values of its embedding."""
    _, books = read_features(x.spark, prepared_features(x))

    def long(kind: str, entries: Column) -> DataFrame:
        return books.select(N.BOOK, F.lit(kind).alias("kind"), F.inline_outer(entries)).filter(F.col("idx").isNotNull())

    def entry(i: Column, v: Column) -> Column:
        return F.struct(i.cast("bigint").alias("idx"), F.round(v.cast("double"), 6).alias("value"))

    # Nearly all weights are zero; only the stored ones become rows.
    weights = F.transform(tfidf.vector_entries(F.col(N.TFIDF)), lambda e: entry(e["idx"], e["value"]))
    numbers = F.transform(F.col(N.EMBEDDING), lambda v, i: entry(i, v))
    return long(N.TFIDF, F.filter(weights, lambda e: e["value"] != 0)).unionByName(long(N.EMBEDDING, numbers))


# Patience ends the growth; the bound on the rounds is the default. The larger step makes the best round come early, and
# trees are shallow, as each level of a tree costs MLlib a pass over all text features.
SHORT_BOOSTING = boosting.BoostingSettings(
    patience=2, first_rounds=4, step_size=0.1, max_depth=4, extra={"maxMemoryInMB": 512}
)


@workflow
def gbt_fit_predict(x: Fixtures) -> DataFrame:
    """Train on prepared features, store the model, load it and predict the test rows."""
    folder, model = prepared_features(x), fresh_path(x.spark, "model")
    train(x.spark, folder, model, SHORT_BOOSTING)
    return predict(x.spark, folder, model)


@workflow
def gbt_best_round(x: Fixtures) -> DataFrame:
    """The validation loss of each round and the round that early stopping keeps."""
    folder, model = prepared_features(x), fresh_path(x.spark, "model")
    report = train(x.spark, folder, model, SHORT_BOOSTING)
    lines = [(i, loss, i == report.best_round) for i, loss in enumerate(report.losses, start=1)]
    return x.spark.createDataFrame(lines, "round INT, loss DOUBLE, kept BOOLEAN")


# One tree of two levels over two 0/1 features, without sampling, holds the mean rating of each of the four groups.
ONE_TREE = boosting.BoostingSettings(
    max_rounds=1, first_rounds=1, max_depth=2, feature_share=1.0, row_share=1.0, min_rows_per_leaf=1
)


def _parities(x: Fixtures, rows: DataFrame) -> DataFrame:
    parities = [(F.col(c) % 2).cast("double").alias(f"{c}_odd") for c in N.PAIR]
    assembler = VectorAssembler(inputCols=[f"{c}_odd" for c in N.PAIR], outputCol=matrix.FEATURES)
    return assembler.transform(rows.select("*", *parities)).drop(*assembler.getInputCols())


def _fitted(early: DataFrame, late: DataFrame, settings: boosting.BoostingSettings) -> boosting.BoostingResult:
    """Boosting on two features, with the early rows dealt into tasks of bounded size, as `train` deals them."""
    dealt = in_fixed_order(with_place(early), early.count(), rows_per_partition(2))
    return boosting.fit_boosting(dealt.drop(PLACE), late, settings)


def _one_tree(x: Fixtures) -> tuple[boosting.BoostingResult, DataFrame]:
    """The tree of the early part and the late part of the rated rows."""
    rated = x.rated_log.filter(F.col(N.SOURCE) == N.TRAIN)
    early, late = temporal.temporal_parts(rated, temporal.split_date(rated).first().split_date)
    parts = [stored(_parities(x, p).select(*N.PAIR, N.RATING, matrix.FEATURES), "parities") for p in (early, late)]
    return _fitted(*parts, ONE_TREE), parts[1]


@workflow
def gbt_group_means(x: Fixtures) -> DataFrame:
    """The tree, stored and loaded again, on the test rows."""
    fitted, _ = _one_tree(x)
    path = fresh_path(x.spark, "model")
    fitted.model.write().save(path)
    asked = _parities(x, x.test)
    predicted = boosting.predict_ratings(GBTRegressionModel.load(path), asked)
    return predicted.select(*N.PAIR, F.round(N.PREDICTION, 6).alias(N.PREDICTION))


@workflow
def gbt_group_loss(x: Fixtures) -> DataFrame:
    """The validation loss that early stopping looks at, and the errors of the model."""
    fitted, late = _one_tree(x)
    errors = metrics.regression_metrics(fitted.model.transform(late))
    return errors.select(
        F.lit(fitted.best).cast("bigint").alias("best_round"), F.lit(round(fitted.losses[0], 6)).alias("loss"), "n",
        F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"),
    )


# Trees of one level over two 0/1 features, without sampling: each round moves two halves of the four groups.
STUMPS = boosting.BoostingSettings(
    max_rounds=16, patience=3, first_rounds=4, step_size=0.2, max_depth=1, feature_share=1.0, row_share=1.0, min_rows_per_leaf=1
)


@workflow
def gbt_stump_rounds(x: Fixtures) -> DataFrame:
    """The validation loss of each round until early stopping settles, and the round that it keeps.

    The features pass through the library's own assembly: a text category, numbered by its levels, and a plain number.
    Ratings in the fixtures depend on nothing, so both features are given a share in them.
    """
    features = [
        F.when(F.col(N.USER) % 2 == 0, "even").otherwise("odd").alias(N.GENDER),
        (F.col(N.BOOK) % 2).cast("double").alias(N.YEAR),
    ]
    shifted = F.col(N.RATING) + 2 * (F.col(N.USER) % 2) + F.col(N.BOOK) % 2
    rated = x.rated_log.filter(F.col(N.SOURCE) == N.TRAIN).select(*N.PAIR, shifted.alias(N.RATING), N.TIMESTAMP, *features)
    early, late = temporal.temporal_parts(rated, temporal.split_date(rated).first().split_date)
    levels = matrix.category_levels(early)
    assembler = matrix.assembler(matrix.feature_columns(early.drop(*N.PAIR)))
    parts = []
    for part in (early, late):
        indexed = matrix.index_categories(part, levels, find_heavy(part, [N.GENDER]))
        parts.append(stored(assembler.transform(indexed).select(*N.PAIR, N.RATING, matrix.FEATURES), "stump-input"))
    fitted = _fitted(*parts, STUMPS)
    judged = fitted.losses[: fitted.best + STUMPS.patience]
    lines = [(i, round(loss, 6), i == fitted.best) for i, loss in enumerate(judged, start=1)]
    return x.spark.createDataFrame(lines, "round BIGINT, loss DOUBLE, kept BOOLEAN")
