"""Registered queries: each takes the session and the folder of driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import names as N
from ratewright.functions import clip_rating, masked_mean, terms, tokens
from ratewright.operators import (
    aggregates,
    checks,
    embeddings,
    formation,
    keys,
    lookups,
    matrix,
    merge,
    metrics,
    missing,
    temporal,
    tfidf,
)

from ratewright.operators.skew import find_heavy, salted_join
from ratewright.plans.prepare import filled_rows
from ratewright.plans.train import heavy_keys, leakfree_rows
from ratewright.session import stored

from . import workflows
from .fixtures import BOUNDARY, Fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[run.__name__] = lambda spark, folder: run(Fixtures(spark, folder))
    return run


def r6(column: str | Column) -> Column:
    """Six digits, the precision at which two engines' sums agree."""
    name = column if isinstance(column, str) else None
    rounded = F.round(F.col(column) if name else column, 6)
    return rounded.alias(name) if name else rounded


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


# Dataset formation


@query
def chunk_counts(x: Fixtures) -> DataFrame:
    parts = formation.time_chunks(x.log, BOUNDARY)
    first, second = (p.withColumn("chunk", F.lit(i)) for i, p in enumerate(parts, start=1))
    both = first.unionByName(second)
    return both.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min(N.TIMESTAMP).alias("first_time"), F.max(N.TIMESTAMP).alias("last_time")
    )


@query
def clean_anomalies(x: Fixtures) -> DataFrame:
    """A log in which the planned items of some orders lines kept their rating, and the rows that survive cleaning."""
    keeps = (F.col(N.HAS_READ) == 1) | (F.col("l_linenumber") == 7)
    dirty = x.unfiltered_log.withColumn(N.RATING, F.when(keeps, F.col(N.RATING)).otherwise(0.0))
    return formation.drop_anomalies(dirty).select(N.USER, N.BOOK, N.HAS_READ, N.RATING, N.TIMESTAMP)


@query
def last_read_per_user(x: Fixtures) -> DataFrame:
    return formation.last_read(x.log.filter(x.in_test()))


@query
def warm_users(x: Fixtures) -> DataFrame:
    return formation.warm_users(x.train)


@query
def keep_warm_users(x: Fixtures) -> DataFrame:
    """Last reads of users with at least 20 planned items or 30 reads, a rule that some users of the fixture fail."""
    last = formation.last_read(x.log.filter(x.in_test()))
    return formation.keep_warm(last, formation.warm_users(x.train, min_reads=30, min_planned=20))


@query
def test_formation(x: Fixtures) -> DataFrame:
    return x.formed_solution


@query
def book_avg_rating(x: Fixtures) -> DataFrame:
    return rounded(formation.book_average(x.log))


@query
def book_avg_rating_all(x: Fixtures) -> DataFrame:
    return rounded(formation.book_average(x.log, include_planned=True))


@query
def genre_books_count(x: Fixtures) -> DataFrame:
    return formation.genre_sizes(x.book_genres)


# Merge


@query
def rated_interactions(x: Fixtures) -> DataFrame:
    return merge.keep_rated(x.train)


@query
def dedupe_books(x: Fixtures) -> DataFrame:
    return keys.keep_first(x.books, [N.BOOK])


@query
def merged_interactions(x: Fixtures) -> DataFrame:
    return merge.merge_interactions(x.rated_log, x.users, x.books, x.heavy)


def _merged(x: Fixtures) -> DataFrame:
    return merge.merge_interactions(x.rated_log, x.users, x.books, x.heavy)


def _prepared(x: Fixtures) -> DataFrame:
    return filled_rows(x.rated_log, x.users, x.books, x.book_genres)[1]


# Aggregates


@query
def user_agg(x: Fixtures) -> DataFrame:
    return rounded(aggregates.user_stats(x.rated))


@query
def book_agg(x: Fixtures) -> DataFrame:
    return rounded(aggregates.book_stats(x.rated))


@query
def author_agg(x: Fixtures) -> DataFrame:
    return rounded(aggregates.author_stats(_merged(x).filter(F.col(N.SOURCE) == N.TRAIN)))


@query
def genre_count(x: Fixtures) -> DataFrame:
    return aggregates.genre_counts(x.book_genres)


@query
def attach_genre_count(x: Fixtures) -> DataFrame:
    rows = x.rated_log.select(N.USER, N.BOOK, N.SOURCE, N.TIMESTAMP)
    return aggregates.attach_genre_counts(rows, x.book_genres, x.heavy)


STATS = [N.USER_MEAN, N.USER_COUNT, N.BOOK_MEAN, N.BOOK_COUNT, N.AUTHOR_MEAN]


@query
def aggregate_features(x: Fixtures) -> DataFrame:
    """Test rows with the aggregates of all train rows."""
    rows = stored(_merged(x), "merged", [N.SOURCE])
    test, train = (rows.filter(F.col(N.SOURCE) == s) for s in (N.TEST, N.TRAIN))
    return rounded(aggregates.attach_rating_stats(test, train, heavy_keys(test)).select(*N.PAIR, *STATS))


@query
def aggregate_features_split(x: Fixtures) -> DataFrame:
    """The same with every key of more than twenty rows treated as heavy, in the merge and in the attachment."""
    heavy = find_heavy(x.rated_log, N.PAIR, piece_rows=20)
    rows = stored(merge.merge_interactions(x.rated_log, x.users, x.books, heavy), "merged", [N.SOURCE])
    test, train = (rows.filter(F.col(N.SOURCE) == s) for s in (N.TEST, N.TRAIN))
    heavy = find_heavy(rows, [N.USER, N.BOOK, N.AUTHOR], piece_rows=20)
    return rounded(aggregates.attach_rating_stats(test, train, heavy).select(*N.PAIR, *STATS))


@query
def age_median(x: Fixtures) -> DataFrame:
    # Three passes read the ages, so they are stored as `prepare` stores the merged rows.
    return missing.exact_median(stored(_merged(x).select(N.AGE), "ages"), N.AGE, "age_median")


@query
def global_mean_rating(x: Fixtures) -> DataFrame:
    return rounded(missing.global_mean(x.rated))


@query
def fill_missing(x: Fixtures) -> DataFrame:
    return rounded(_prepared(x))


@query
def fill_after_aggregates(x: Fixtures) -> DataFrame:
    """Test rows, filled, aggregated and filled again as scoring does; unknown authors share one pseudo-author."""
    rows = stored(_prepared(x), "prepared", [N.SOURCE])
    test, train = (rows.filter(F.col(N.SOURCE) == s) for s in (N.TEST, N.TRAIN))
    filled = missing.fill_missing(aggregates.attach_rating_stats(test, train, heavy_keys(test)), train)
    return rounded(filled.select(*N.PAIR, N.AUTHOR, N.AGE, *STATS))


# Split by time


@query
def split_date(x: Fixtures) -> DataFrame:
    return temporal.split_date(x.read("lineitem"), 0.8, "l_shipdate")


@query
def split_date_events(x: Fixtures) -> DataFrame:
    """Split dates of a log with microsecond times, for two ratios."""
    events = x.read("events")
    found = [temporal.split_date(events, r, "ts").select(F.lit(r).alias("ratio"), "split_date") for r in (0.5, 0.8)]
    return found[0].unionByName(found[1])


@query
def temporal_split(x: Fixtures) -> DataFrame:
    cut = temporal.split_date(x.rated).scalar()
    early, late = temporal.temporal_parts(x.rated, cut)
    parts = early.withColumn("part", F.lit("train")).unionByName(late.withColumn("part", F.lit("validation")))
    return parts.select(N.USER, N.BOOK, N.RATING, N.TIMESTAMP, "part")


@query
def split_bounds(x: Fixtures) -> DataFrame:
    return temporal.split_bounds(x.rated, temporal.split_date(x.rated).scalar())


@query
def leakfree_aggregates(x: Fixtures) -> DataFrame:
    """Both parts of the train rows with the aggregates of the early part, filled."""
    rows = stored(_prepared(x), "prepared", [N.SOURCE]).filter(F.col(N.SOURCE) == N.TRAIN)
    both = leakfree_rows(rows, temporal.split_date(rows).scalar(), heavy_keys(rows))
    return rounded(both.select(*N.PAIR, N.TIMESTAMP, N.RATING, "part", *STATS))


# Text


@query
def tokenize(x: Fixtures) -> DataFrame:
    docs = x.read("documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return docs.select(
        "doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5")
    )


@query
def ngrams(x: Fixtures) -> DataFrame:
    docs = x.read("documents").select("doc_id", terms(tokens(F.col("text"))).alias("t"))
    return docs.select(
        "doc_id", F.size("t").cast("bigint").alias("n_terms"), F.md5(F.array_join("t", "|")).alias("terms_md5")
    )


@query
def train_descriptions(x: Fixtures) -> DataFrame:
    return lookups.descriptions_of(x.descriptions, x.rated, x.heavy_descriptions)


@query
def description_lookup(x: Fixtures) -> DataFrame:
    rows = x.rated_log.select(N.USER, N.BOOK, N.SOURCE, N.TIMESTAMP)
    found = lookups.attach_descriptions(rows, x.descriptions, x.heavy)
    return found.select(
        *rows.columns,
        F.length(N.DESCRIPTION).cast("bigint").alias("n_chars"),
        F.md5(N.DESCRIPTION).alias("description_md5"),
    )


@query
def tfidf_vocab(x: Fixtures) -> DataFrame:
    return rounded(tfidf.fit_vocabulary(lookups.descriptions_of(x.descriptions, x.rated, x.heavy_descriptions)))


@query
def tfidf_weights(x: Fixtures) -> DataFrame:
    vocabulary = tfidf.fit_vocabulary(lookups.descriptions_of(x.descriptions, x.rated, x.heavy_descriptions))
    return rounded(tfidf.tfidf_weights(lookups.last_descriptions(x.descriptions), vocabulary))


@query
def embedding_texts(x: Fixtures) -> DataFrame:
    return lookups.first_descriptions(x.descriptions)


@query
def embedding_cache_missing(x: Fixtures) -> DataFrame:
    return embeddings.books_to_encode(lookups.first_descriptions(x.descriptions), x.embeddings).select(N.BOOK)


@query
def embed_missing_books(x: Fixtures) -> DataFrame:
    """Books missing from the cache, encoded with a stand-in model: a token's vector holds two bytes of its MD5."""
    missing_texts = embeddings.books_to_encode(lookups.first_descriptions(x.descriptions), x.embeddings)
    encoded = embeddings.encode_books(missing_texts, workflows.hashing_encoder())
    return encoded.select(N.BOOK, F.posexplode(N.EMBEDDING).alias("dim", "value")).select(
        N.BOOK, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 2).alias("value")
    )


@query
def embedding_lookup(x: Fixtures) -> DataFrame:
    """Each row's embedding, shown by its width, its end values and its squared length."""
    rows = x.rated_log.select(N.USER, N.BOOK, N.SOURCE, N.TIMESTAMP)
    found = lookups.attach_embeddings(rows, x.embeddings, x.heavy, dim=64)
    e = F.col(N.EMBEDDING)
    squared = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return found.select(
        *rows.columns,
        F.size(e).cast("bigint").alias("dim"),
        F.round(F.get(e, F.lit(0)).cast("double"), 6).alias("first_value"),
        F.round(F.get(e, F.lit(63)).cast("double"), 6).alias("last_value"),
        F.round(squared, 6).alias("squared_length"),
    )


# The stored vectors read as eight token vectors of eight numbers each, with some tokens masked.
TOKENS = 8
WIDTH = 8


def _mask(pos: Column) -> Column:
    return F.when((F.col("vec_id") % 11 != 0) & ((F.col("vec_id") + pos) % 3 != 0), 1).otherwise(0)


@query
def masked_mean_pool(x: Fixtures) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(TOKENS - 1))
    docs = x.read("embeddings").select(
        "vec_id",
        F.transform(places, lambda p: F.slice("embedding", p * WIDTH + 1, F.lit(WIDTH))).alias("hidden"),
        F.transform(places, _mask).alias("mask"),
    )
    pooled = docs.select("vec_id", F.posexplode(masked_mean(F.col("hidden"), F.col("mask"))).alias("dim", "pooled"))
    return pooled.select("vec_id", F.col("dim").cast("bigint").alias("dim"), r6("pooled"))


@query
def masked_mean_pool_long(x: Fixtures) -> DataFrame:
    places = x.read("embeddings").select("vec_id", F.posexplode("embedding").alias("place", "value"))
    pos = F.floor(F.col("place") / WIDTH)
    long = places.select(
        "vec_id",
        pos.alias("pos"),
        _mask(pos).alias("mask"),
        (F.col("place") % WIDTH).cast("bigint").alias("dim"),
        F.col("value").cast("double").alias("value"),
    )
    return rounded(embeddings.pool_tokens(long, "vec_id"))


# Learner input


@query
def feature_matrix(x: Fixtures) -> DataFrame:
    return rounded(matrix.feature_matrix(_prepared(x)))


@query
def categorical_index(x: Fixtures) -> DataFrame:
    rows = _merged(x).select(N.USER, N.BOOK, N.SOURCE, N.TIMESTAMP, *N.TEXT_CATEGORIES)
    filled = stored(rows.fillna(N.MISSING_TEXT, N.TEXT_CATEGORIES), "categories")
    heavy = find_heavy(filled, N.TEXT_CATEGORIES)
    indexed = matrix.index_categories(filled, matrix.category_levels(filled), heavy)
    return indexed.select(
        N.USER, N.BOOK, N.SOURCE, N.TIMESTAMP,
        *[F.col(matrix.index_name(c)).cast("bigint").alias(matrix.index_name(c)) for c in N.TEXT_CATEGORIES],
    )


# Prediction and scores


@query
def mean_baseline(x: Fixtures) -> DataFrame:
    return rounded(workflows.baseline(x))


@query
def clip_predictions(x: Fixtures) -> DataFrame:
    """Values around and outside the rating range, some missing."""
    raw = F.when(F.col("c_nationkey") % 7 != 3, F.col("c_acctbal") / F.lit(800.0))
    values = x.read("customer").select(F.col("c_custkey").alias(N.USER), raw.alias("raw"))
    return values.withColumn(N.PREDICTION, clip_rating(F.col("raw")))


@query
def score_by_stage(x: Fixtures) -> DataFrame:
    return rounded(metrics.score_by_stage(workflows.baseline(x), x.solution))


@query
def regression_metrics(x: Fixtures) -> DataFrame:
    """Errors on the late part of predicting each book's early mean."""
    rated = x.rated_log.filter(F.col(N.SOURCE) == N.TRAIN)
    early, late = temporal.temporal_parts(rated, temporal.split_date(rated).scalar())
    stats = aggregates.book_stats(early).select(N.BOOK, F.col(N.BOOK_MEAN).alias(N.PREDICTION))
    scored = salted_join(late, stats, N.BOOK, "inner", [N.USER, N.TIMESTAMP], heavy=x.heavy)
    return rounded(metrics.regression_metrics(scored))


@query
def prediction_stats(x: Fixtures) -> DataFrame:
    return rounded(metrics.prediction_stats(workflows.baseline(x)))


@query
def source_counts(x: Fixtures) -> DataFrame:
    """Rows per source and number of feature columns of the merged frame."""
    rows = _merged(x)
    n_features = len(matrix.feature_columns(rows))
    return rows.groupBy(N.SOURCE).agg(
        F.count("*").alias("n_rows"), F.lit(n_features).cast("bigint").alias("n_features")
    )


# Checks


def _clean_submission(x: Fixtures) -> DataFrame:
    return workflows.baseline(x).withColumn(N.PREDICTION, F.col(N.PREDICTION).cast("string"))


def _broken_submission(x: Fixtures) -> DataFrame:
    user = F.col(N.USER)
    value = (
        F.when(user % 13 == 1, None).when(user % 17 == 2, "n/a").when(user % 19 == 3, "10.5").otherwise("5.25")
    )
    base = x.solution.filter(user % 9 != 0).select(*N.PAIR, value.alias(N.PREDICTION))
    again = x.solution.filter(user % 10 == 3).select(*N.PAIR, F.lit("5.0").alias(N.PREDICTION))
    extra = x.solution.filter(user % 11 == 5).select(
        N.USER, (F.col(N.BOOK) + 1000000).alias(N.BOOK), F.lit("5.0").alias(N.PREDICTION)
    )
    return base.unionByName(again).unionByName(extra)


def _broken_solution(x: Fixtures) -> DataFrame:
    user = F.col(N.USER)
    rating = (
        F.when(user % 13 == 1, None)
        .when(user % 17 == 2, "bad")
        .when(user % 19 == 3, "11")
        .when(user % 23 == 4, "-1")
        .otherwise("7.5")
    )
    stage = F.when(user % 7 == 1, None).when(user % 7 == 2, "other").otherwise(N.PUBLIC)
    base = x.solution.select(*N.PAIR, rating.alias(N.RATING), stage.alias(N.STAGE))
    again = x.solution.filter(user % 10 == 3).select(
        *N.PAIR, F.lit("1.0").alias(N.RATING), F.lit(N.PUBLIC).alias(N.STAGE)
    )
    return base.unionByName(again)


def _cases(clean: DataFrame, broken: DataFrame) -> DataFrame:
    return clean.withColumn("input", F.lit("clean")).unionByName(broken.withColumn("input", F.lit("broken")))


@query
def validate_submission(x: Fixtures) -> DataFrame:
    return _cases(*[checks.validate_submission(s, x.solution) for s in (_clean_submission(x), _broken_submission(x))])


@query
def validate_solution(x: Fixtures) -> DataFrame:
    return _cases(*[checks.validate_solution(s) for s in (x.solution, _broken_solution(x))])


@query
def check_submission(x: Fixtures) -> DataFrame:
    return _cases(*[checks.check_submission(s, x.test) for s in (_clean_submission(x), _broken_submission(x))])


@query
def pair_diff(x: Fixtures) -> DataFrame:
    return checks.pair_diff(_broken_submission(x), x.solution)


@query
def lost_pairs(x: Fixtures) -> DataFrame:
    return checks.lost_pairs(_broken_submission(x), x.solution)


@query
def lost_pair_examples(x: Fixtures) -> DataFrame:
    lost = checks.lost_pairs(_broken_submission(x), x.solution)
    by_stage = [
        checks.examples(lost.filter(F.col(N.STAGE) == stage), N.PAIR) for stage in (N.PUBLIC, N.PRIVATE)
    ]
    return by_stage[0].unionByName(by_stage[1])


@query
def validation_examples(x: Fixtures) -> DataFrame:
    """Up to five pairs per failed check, and per stage where predictions are missing."""
    found = checks.submission_examples(_broken_submission(x), x.solution).withColumn("input", F.lit("submission"))
    return found.unionByName(checks.solution_examples(_broken_solution(x)).withColumn("input", F.lit("solution")))


@query
def repeated_pairs(x: Fixtures) -> DataFrame:
    return checks.repeated_pairs(_broken_submission(x))


@query
def out_of_range_ratings(x: Fixtures) -> DataFrame:
    return checks.out_of_range(_broken_solution(x)).select(*N.PAIR, N.RATING)


# Files and whole runs

for _name, _run in workflows.WORKFLOWS.items():
    QUERIES[_name] = (lambda run: lambda spark, folder: run(Fixtures(spark, folder)))(_run)
