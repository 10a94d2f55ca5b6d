"""Predictions for the test rows of stored features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from ..operators import aggregates, boosting, matrix, missing
from ..sources import read_features
from .train import attach_vectors, heavy_keys


def predict(spark: SparkSession, folder: str, model_path: str) -> DataFrame:
    """Keys and clipped predictions; aggregates come from all train rows."""
    rows, books = read_features(spark, folder)
    known, asked = (rows.filter(F.col(N.SOURCE) == s) for s in (N.TRAIN, N.TEST))
    model = PipelineModel.load(f"{model_path}/pipeline")
    levels = spark.read.parquet(f"{model_path}/levels")
    heavy = heavy_keys(asked)
    filled = missing.fill_missing(aggregates.attach_rating_stats(asked, known, heavy), known)
    inputs = matrix.index_categories(attach_vectors(filled, books, heavy), levels, heavy)
    return boosting.predict_ratings(model, inputs)
