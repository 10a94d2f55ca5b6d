import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.operators import aggregates, missing, temporal

START = datetime(2024, 1, 1)


def times(spark, values):
    return spark.createDataFrame([(v,) for v in values], "timestamp TIMESTAMP_NTZ")


def brute_split(values, ratio):
    ordered = sorted(v for v in values if v is not None) + [None] * values.count(None)
    return ordered[int(len(ordered) * ratio)]


@pytest.mark.parametrize(
    "values",
    [
        [START] * 10,
        [START + timedelta(days=i // 4) for i in range(37)],
        [START + timedelta(microseconds=7 * i % 50) for i in range(100)],
        [START + timedelta(seconds=i % 13, microseconds=i * 31 % 1000) for i in range(100)],
        [datetime(1950, 1, 1) + timedelta(hours=i * 977 % 8000) for i in range(100)] + [None] * 5,
        [START] + [None] * 9,
    ],
)
@pytest.mark.parametrize("ratio", [0.29, 0.5, 0.8])
def test_split_date_is_the_element_at_its_place(spark, values, ratio):
    shuffled = list(values)
    random.Random(1).shuffle(shuffled)
    assert temporal.split_date(times(spark, shuffled), ratio).first().split_date == brute_split(values, ratio)


def test_split_date_reads_text(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 10:30:00",), ("2024-01-03",)], "timestamp STRING")
    assert temporal.split_date(df, 0.5).first().split_date == datetime(2024, 1, 2, 10, 30)


def test_malformed_times_are_not_lost(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("bad",)], "timestamp STRING")
    with pytest.raises(Exception, match="not a time: bad"):
        temporal.temporal_parts(df, datetime(2024, 1, 1))[0].collect()


@pytest.mark.parametrize("ratio", [0, 1, -0.1, 1.5])
def test_ratio_must_lie_inside_the_unit_interval(spark, ratio):
    with pytest.raises(ValueError, match="ratio"):
        temporal.split_date(times(spark, [START]), ratio)


def test_missing_time_column(spark):
    with pytest.raises(ValueError, match="missing columns"):
        temporal.split_date(spark.range(1), 0.5)


def test_rows_at_the_date_are_early_and_rows_without_time_nowhere(spark):
    df = times(spark, [START, START + timedelta(days=1), START + timedelta(days=2), None])
    early, late = temporal.checked_parts(df, START + timedelta(days=1))
    assert (early.count(), late.count()) == (2, 1)


@pytest.mark.parametrize("date", [START - timedelta(days=1), START + timedelta(days=9)])
def test_empty_part_is_an_error(spark, date):
    with pytest.raises(ValueError, match="no rows"):
        temporal.checked_parts(times(spark, [START, START + timedelta(days=2)]), date)


@pytest.mark.parametrize("kind", ["many", "even", "heavy", "wide", "one", "nan", "none"])
def test_median_of_any_doubles(spark, kind):
    chance = np.random.default_rng(3)
    values = {
        "many": chance.normal(size=40_001),
        "even": chance.normal(size=40_000) * 1e-300,
        "heavy": np.where(chance.random(30_000) < 0.49, chance.random(30_000), 5.0),
        "wide": np.concatenate([10.0 ** chance.integers(-300, 300, 20_000), [-np.inf, np.inf]]),
        "one": np.array([4.25]),
        "nan": np.array([np.nan, 1.0, 2.0, np.nan]),
        "none": np.array([np.nan]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x DOUBLE").repartition(4)
    found = missing.exact_median(df, "x", "m").first().m
    given = values[~np.isnan(values)]
    assert found == (np.median(given) if len(given) else None)


def test_median_interpolates_and_ignores_missing(spark):
    df = spark.createDataFrame([(2.0,), (3.0,), (3.0,), (10.0,), (None,), (1.0,)], "age DOUBLE")
    assert missing.exact_median(df, "age", "m").first().m == 3.0
    df = spark.createDataFrame([(2.0,), (4.0,)], "age DOUBLE")
    assert missing.exact_median(df, "age", "m").first().m == 3.0


ROWS = (
    "user_id INT, book_id INT, gender STRING, age DOUBLE, author_id INT, avg_rating DOUBLE, book_genres_count BIGINT, "
    "user_mean_rating DOUBLE, user_ratings_count BIGINT, publisher STRING, title STRING"
)


def test_fill_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, None, None, None, None, None, None, None, None, None), (2, 2, "1", 20.0, 5, 3.0, 2, 4.0, 9, "7", "t")], ROWS
    )
    train = spark.createDataFrame([(6.0,), (7.0,)], "rating DOUBLE")
    filled = {r.user_id: r for r in missing.fill_missing(df, train).collect()}
    assert tuple(filled[1]) == (1, 1, "-1", 20.0, -1, 6.5, 0, 6.5, 0, "-1", None)
    assert tuple(filled[2]) == (2, 2, "1", 20.0, 5, 3.0, 2, 4.0, 9, "7", "t")
    assert {r.gender for r in missing.fill_missing(df, train, missing_text="nan").collect()} == {"nan", "1"}


def test_validation_ratings_never_reach_the_aggregates(spark):
    schema = "user_id INT, book_id INT, author_id INT, rating DOUBLE, timestamp TIMESTAMP_NTZ"
    data = [(u, b, b % 3, float((u + b) % 11), START + timedelta(days=(u * 7 + b) % 20)) for u in range(8) for b in range(8)]
    cut = START + timedelta(days=12)

    def features(changed):
        moved = [(u, b, a, 10.0 if changed and t > cut else r, t) for u, b, a, r, t in data]
        early, late = temporal.temporal_parts(spark.createDataFrame(moved, schema), cut)
        both = aggregates.attach_rating_stats(early.unionByName(late), early, {})
        return sorted(tuple(r) for r in both.drop("rating").orderBy("user_id", "book_id").fillna(-1).collect())

    assert features(False) == features(True)


def test_parts_take_a_scalar_subquery(spark):
    df = times(spark, [START + timedelta(days=i) for i in range(10)])
    early, late = temporal.temporal_parts(df, temporal.split_date(df, 0.5).scalar())
    assert (early.count(), late.agg(F.min("timestamp")).first()[0]) == (6, START + timedelta(days=6))


def test_split_date_narrows_its_scans(spark, tmp_path, capsys):
    """The second and third pass filter the time column by bounds that are known before their scan starts."""
    path = str(tmp_path / "times")
    rows = spark.range(500).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id"))).alias("t"))
    rows.write.parquet(path)
    found = temporal.split_date(spark.read.parquet(path), 0.5, "t")
    assert found.first().split_date == rows.orderBy("t").collect()[250].t
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert ">= Subquery" in plan or ">= scalar-subquery" in plan
