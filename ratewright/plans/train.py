"""Training on stored features with a split by time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from ..functions import time_literal
from ..operators import aggregates, boosting, matrix, metrics, missing, temporal
from ..operators.skew import HeavyKeys, find_heavy, salted_join
from ..session import stored
from ..sources import read_features

PART, EARLY, LATE = "part", "train", "validation"

PLACE = "place"
ROWS_PER_PARTITION = 50_000
# The learner keeps four bytes per feature of a fitted row and about a hundred besides; a task holds about so many bytes.
TASK_BYTES = 32 * 2**20


@dataclass(frozen=True)
class TrainingReport:
    split_date: datetime
    best_round: int
    losses: list[float]
    rmse: float
    mae: float


def heavy_keys(rows: DataFrame) -> HeavyKeys:
    return find_heavy(rows, [N.USER, N.BOOK, N.AUTHOR, *[c for c in N.TEXT_CATEGORIES if c in rows.columns]])


def leakfree_rows(known: DataFrame, cut: Column, heavy: HeavyKeys) -> DataFrame:
    """Rows up to `cut` and rows after it, named in `part`, with the rating aggregates of the former, filled.

    Each aggregate is made once and joined to both parts in one pass. Rows without a time are in neither part.
    """
    time = F.col(N.TIMESTAMP)
    part = F.when(time <= cut, EARLY).when(time > cut, LATE)
    parts = known.withColumn(PART, part).filter(F.col(PART).isNotNull())
    early = known.filter(time <= cut)
    return missing.fill_missing(aggregates.attach_rating_stats(parts, early, heavy), early)


def attach_vectors(rows: DataFrame, book_vectors: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """The text vectors of each row's book."""
    return salted_join(rows, matrix.vectors_ready(book_vectors), N.BOOK, "left", [N.USER, N.TIMESTAMP], heavy=heavy)


def with_place(rows: DataFrame) -> DataFrame:
    """`rows` with a number that follows from the values of all columns but arrays, maps and structs."""
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in {"array", "map", "struct", "udt"}]
    return rows.withColumn(PLACE, F.xxhash64(*sorted(plain)))


def rows_per_partition(n_features: int) -> int:
    """Rows of so many features that one task of the learner holds: wide rows go to more tasks, narrow ones to fewer."""
    return max(1, TASK_BYTES // (4 * n_features + 100))


def in_fixed_order(rows: DataFrame, n: int, per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The same rows in the same partitions and order in every run, whatever the cores and the order of arrival.

    The learner draws its bags and its candidate splits by partition and position, so a seed alone does not fix them. Rows
    are dealt by their `place` into partitions whose number depends on the `n` rows only, and sorted there. Rows of one
    place are equal but for a collision of hashes.
    """
    partitions = max(1, -(-n // per_partition))
    return rows.repartition(partitions, PLACE).sortWithinPartitions(PLACE, *N.PAIR, N.RATING)


def train(
    spark: SparkSession,
    folder: str,
    model_path: str,
    settings: boosting.BoostingSettings | None = None,
    ratio: float = N.SPLIT_RATIO,
) -> TrainingReport:
    """Split by time, fit with early stopping on the later part, store the model with the numbers of its categories, and
    report the validation errors.

    Aggregates come from all rows of the early part and of no other, and the trees are grown on all of them; validation
    and scoring use all rows as well. MLlib keeps a number for every feature of every fitted row, in memory and beyond that
    on disk. The assembled inputs are written before the fit, which reads them many times over. With one seed and the same
    rows two runs fit the same trees.
    """
    rows, books = read_features(spark, folder)
    known = rows.filter(F.col(N.SOURCE) == N.TRAIN)
    date = temporal.split_date(known, ratio).first().split_date
    if date is None:
        raise ValueError("the split date falls among rows without a time")
    n_early = temporal.checked_bounds(known, date).n_train
    early, _ = temporal.temporal_parts(known, date)

    heavy = heavy_keys(known)
    rows = leakfree_rows(known, time_literal(date), heavy)
    inputs = attach_vectors(with_place(rows), books, heavy)
    levels = matrix.category_levels(early)
    assembler = matrix.assembler(matrix.feature_columns(inputs.drop(PART, PLACE)))
    indexed = matrix.index_categories(inputs, levels, heavy)
    assembled = assembler.transform(indexed).select(*N.PAIR, N.RATING, PART, PLACE, matrix.FEATURES)
    both = stored(assembled, "learner-input", [PART])
    ready = {name: both.filter(F.col(PART) == name) for name in (EARLY, LATE)}
    n_features = ready[EARLY].select(matrix.FEATURES).first()[0].size
    ready[EARLY] = in_fixed_order(ready[EARLY], n_early, rows_per_partition(n_features))

    fitted = boosting.fit_boosting(ready[EARLY], ready[LATE], settings or boosting.BoostingSettings())
    errors = metrics.regression_metrics(fitted.model.transform(ready[LATE])).first()
    levels.write.mode("overwrite").parquet(f"{model_path}/levels")
    PipelineModel([assembler, fitted.model]).write().overwrite().save(f"{model_path}/pipeline")
    return TrainingReport(date, fitted.best, fitted.losses, errors.rmse, errors.mae)
