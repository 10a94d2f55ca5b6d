"""RMSE, MAE and Score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions import clip_rating
from .aggregates import book_stats
from .missing import global_mean
from .skew import HeavyKeys, salted_join

# Fixed value: width of the rating range, by which both errors are divided.
RANGE_WIDTH = 10.0


def join_solution(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """Predictions next to true ratings, for the pairs in both tables."""
    truth = solution.select(*N.PAIR, N.RATING, N.STAGE)
    return submission.select(*N.PAIR, N.PREDICTION).join(truth, N.PAIR)


def score(rmse: Column, mae: Column) -> Column:
    return 1 - (0.5 * rmse / RANGE_WIDTH + 0.5 * mae / RANGE_WIDTH)


def score_by_stage(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """One row `(stage, n, rmse, mae, score)` per stage, with predictions clipped; a stage without rows has zeros.

    Both stages come from one aggregation, so a stage without rows still has its line.
    """
    error = clip_rating(F.col(N.PREDICTION)) - F.col(N.RATING)
    errors = join_solution(submission, solution).select(N.STAGE, error.alias("e"))
    values = []
    for stage in (N.PUBLIC, N.PRIVATE):
        e = F.when(F.col(N.STAGE) == stage, F.col("e"))
        values += [
            F.count_if(F.col(N.STAGE) == stage).alias(f"{stage}_n"),
            F.sqrt(F.avg(e * e)).alias(f"{stage}_rmse"),
            F.avg(F.abs(e)).alias(f"{stage}_mae"),
        ]
    wide = errors.agg(*values)
    lines = [
        F.struct(
            F.lit(stage).alias(N.STAGE),
            F.col(f"{stage}_n").alias("n"),
            F.col(f"{stage}_rmse").alias("rmse"),
            F.col(f"{stage}_mae").alias("mae"),
        )
        for stage in (N.PUBLIC, N.PRIVATE)
    ]
    long = wide.select(F.inline(F.array(*lines)))
    zero = F.lit(0.0)
    return long.select(
        N.STAGE,
        "n",
        F.coalesce("rmse", zero).alias("rmse"),
        F.coalesce("mae", zero).alias("mae"),
        F.coalesce(score(F.col("rmse"), F.col("mae")), zero).alias("score"),
    )


def regression_metrics(scored: DataFrame, truth: str = N.RATING, predicted: str = N.PREDICTION) -> DataFrame:
    """One row with the RMSE and MAE of unclipped predictions."""
    e = F.col(predicted) - F.col(truth)
    return scored.agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def prediction_stats(submission: DataFrame) -> DataFrame:
    p = N.PREDICTION
    return submission.agg(
        F.count("*").alias("n"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean")
    )


def mean_baseline(pairs: DataFrame, train: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """The book's mean train rating, or the global mean for a book without ratings, as a prediction per pair."""
    means = book_stats(train).select(N.BOOK, N.BOOK_MEAN)
    known = salted_join(pairs.select(*N.PAIR), means, N.BOOK, "left", [N.USER], heavy=heavy)
    value = F.coalesce(F.col(N.BOOK_MEAN), global_mean(train).scalar())
    return known.select(*N.PAIR, value.alias(N.PREDICTION))
