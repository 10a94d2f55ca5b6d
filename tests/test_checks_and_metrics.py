import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ratewright.functions import clip_rating, in_rating_range, malformed_number, parse_time, strict_double
from ratewright.operators import checks, metrics
from ratewright.plans import evaluate, upload_check

SUB = "user_id INT, book_id INT, rating_predict STRING"
SOL = "user_id INT, book_id INT, rating STRING, stage STRING"
TRUTH = [(1, 10, "5", "public"), (2, 20, "7.5", "private"), (3, 30, "0", "public")]
GOOD = [(3, 30, "1"), (1, 10, "5.5"), (2, 20, "12")]


def sub(spark, rows):
    return spark.createDataFrame(rows, SUB)


def sol(spark, rows=TRUTH):
    return spark.createDataFrame(rows, SOL)


def failed(report):
    return {r.check: r.bad_rows for r in report.collect() if not r.passed}


def test_clip_keeps_missing_values_and_is_idempotent(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.5,), (10.0,), (99.0,), (None,)], "x DOUBLE")
    once = df.select(clip_rating(F.col("x")).alias("x"))
    assert [r.x for r in once.collect()] == [0.0, 0.0, 5.5, 10.0, 10.0, None]
    assert once.select(clip_rating(F.col("x")).alias("x")).collect() == once.collect()


def test_number_and_range_rules(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("10.01",), ("1e1",)], "s STRING")
    got = df.select(strict_double(F.col("s")), malformed_number(F.col("s")), in_rating_range(strict_double(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [
        (1.5, False, True), (None, True, False), (None, False, False), (None, False, False), (10.01, False, False), (10.0, False, True),
    ]


def test_times_are_parsed_or_refused(spark):
    df = spark.createDataFrame([("2024-02-29 01:02:03",), ("2024-02-29",), (None,)], "s STRING")
    got = [r[0] for r in df.select(parse_time(F.col("s"))).collect()]
    assert got == [datetime(2024, 2, 29, 1, 2, 3), datetime(2024, 2, 29), None]
    with pytest.raises(Exception, match="not a time: 2024-02-30"):
        spark.createDataFrame([("2024-02-30 00:00:00",)], "s STRING").select(parse_time(F.col("s"))).collect()


def test_numbers_with_suffixes_are_malformed(spark):
    df = spark.createDataFrame([("7d",), ("7f",), ("0x1p3",), ("1e3",), (" 7. ",), ("-.5",)], "s STRING")
    got = [tuple(r) for r in df.select(strict_double(F.col("s")), malformed_number(F.col("s"))).collect()]
    assert got == [(None, True)] * 3 + [(1000.0, False), (7.0, False), (-0.5, False)]


def test_clean_submission_passes(spark):
    report = checks.validate_submission(sub(spark, GOOD), sol(spark))
    assert failed(report) == {}
    assert [r.check_no for r in report.orderBy("check_no").collect()] == list(range(1, 9))


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([], {"not_empty": 1, "row_count": 3, "no_missing_pairs": 3}),
        ([(3, 30, "one"), *GOOD[1:]], {"numeric": 1}),
        ([(3, 30, None), (1, 10, "NaN"), GOOD[2]], {"no_nulls": 2}),
        ([*GOOD, GOOD[0], GOOD[0]], {"no_duplicates": 2, "row_count": 2}),
        (GOOD[:2], {"row_count": 1, "no_missing_pairs": 1}),
        ([*GOOD[:2], (2, 21, "3")], {"no_missing_pairs": 1, "no_extra_pairs": 1}),
    ],
)
def test_each_submission_check(spark, rows, expected):
    assert failed(checks.validate_submission(sub(spark, rows), sol(spark))) == expected


def test_missing_columns_end_the_report(spark):
    report = checks.validate_submission(sub(spark, GOOD).drop("rating_predict"), sol(spark))
    assert failed(report) == {"columns": 1} and report.count() == 2
    assert failed(checks.validate_solution(sol(spark).drop("stage", "rating"))) == {"columns": 2}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        (TRUTH, {}),
        ([], {"not_empty": 1, "has_public": 1, "has_private": 1}),
        ([*TRUTH, TRUTH[0]], {"no_duplicates": 1}),
        ([*TRUTH, (4, 1, "bad", "public"), (5, 1, None, "public")], {"numeric": 1, "no_nulls": 1}),
        ([*TRUTH, (4, 1, "10.5", "public"), (5, 1, "-0.5", "private")], {"in_range": 2}),
        ([*TRUTH, (4, 1, "1", None), (5, 1, "2", "secret")], {"stage_not_null": 1, "stage_known": 1}),
        ([TRUTH[0]], {"has_private": 1}),
        ([TRUTH[1]], {"has_public": 1}),
    ],
)
def test_each_solution_check(spark, rows, expected):
    assert failed(checks.validate_solution(sol(spark, rows))) == expected


def test_upload_check(spark):
    test = sol(spark).select("user_id", "book_id")
    assert upload_check(sub(spark, [(1, 10, "1"), (2, 20, "10"), (3, 30, "0")]), test) == []
    assert upload_check(sub(spark, GOOD), test) == ["in_range"]
    assert upload_check(sub(spark, [(1, 10, None), (2, 20, "1")]), test) == ["length", "no_nulls", "keys", "in_range"]
    assert upload_check(sub(spark, [(1, 10, "1"), (1, 10, "1"), (2, 20, "1")]), test) == ["keys"]


def test_ordered_keys(spark):
    test = spark.createDataFrame([(1, 10, 0), (2, 20, 1)], "user_id INT, book_id INT, row_order INT")
    rows = "user_id INT, book_id INT, rating_predict DOUBLE, row_order INT"
    same = spark.createDataFrame([(1, 10, 1.0, 0), (2, 20, 1.0, 1)], rows)
    swapped = spark.createDataFrame([(1, 10, 1.0, 1), (2, 20, 1.0, 0)], rows)
    assert upload_check(same, test, "row_order") == []
    assert upload_check(swapped, test) == []
    assert upload_check(swapped, test, "row_order") == ["keys"]


def test_scores_against_plain_python(spark):
    scores = {r.stage: r for r in evaluate(sub(spark, GOOD), sol(spark)).collect()}
    rmse, mae = math.sqrt((0.5**2 + 1) / 2), 0.75
    assert (scores["public"].n, scores["public"].rmse, scores["public"].mae) == pytest.approx((2, rmse, mae))
    assert scores["public"].score == pytest.approx(1 - (0.05 * rmse + 0.05 * mae))
    assert (scores["private"].n, scores["private"].rmse, scores["private"].mae) == pytest.approx((1, 2.5, 2.5))


def test_perfect_submission_scores_one(spark):
    perfect = sol(spark).withColumnRenamed("rating", "rating_predict").drop("stage")
    assert {r.score for r in evaluate(perfect, sol(spark)).collect()} == {1.0}


def test_empty_stage_scores_zero(spark):
    only = sol(spark, [TRUTH[0]]).withColumn("rating", F.col("rating").cast("double"))
    given = sub(spark, GOOD).withColumn("rating_predict", F.col("rating_predict").cast("double"))
    scores = {r.stage: tuple(r)[1:] for r in metrics.score_by_stage(given, only).collect()}
    assert scores["private"] == (0, 0.0, 0.0, 0.0)


def test_evaluate_raises_for_the_first_failure(spark):
    with pytest.raises(ValueError, match="has_private"):
        evaluate(sub(spark, GOOD), sol(spark, [TRUTH[0]]))
    with pytest.raises(ValueError, match="numeric"):
        evaluate(sub(spark, [(3, 30, "x")]), sol(spark))


def test_examples_are_the_first_by_key(spark):
    many = spark.range(50).select((50 - F.col("id")).alias("user_id"))
    assert [r.user_id for r in checks.examples(many, ["user_id"]).collect()] == [1, 2, 3, 4, 5]


def test_baseline_falls_back_to_the_global_mean(spark):
    train = spark.createDataFrame([(1, 10, 4.0), (2, 10, 8.0), (2, 11, 9.0)], "user_id INT, book_id INT, rating DOUBLE")
    pairs = spark.createDataFrame([(5, 10), (6, 99)], "user_id INT, book_id INT")
    got = {r.book_id: r.rating_predict for r in metrics.mean_baseline(pairs, train, {}).collect()}
    assert got == {10: 6.0, 99: 7.0}


def test_failures_come_with_their_count_and_first_pairs(spark):
    solution = spark.createDataFrame(
        [(u, 1, 5.0, "public" if u % 2 else "private") for u in range(40)], "user_id INT, book_id INT, rating DOUBLE, stage STRING"
    )
    submission = solution.filter("user_id >= 16").selectExpr("user_id", "book_id", "'5' AS rating_predict")
    extra = spark.createDataFrame([(u, 9, "5") for u in range(16)], submission.schema)
    found = checks.submission_examples(submission.unionByName(extra), solution)
    shown = {}
    for r in found.orderBy("place").collect():
        shown.setdefault((r.check, r.stage, r.bad_rows), []).append((r.user_id, r.book_id))
    assert shown == {
        ("no_missing_pairs", None, 16): [(u, 1) for u in range(5)],
        ("no_extra_pairs", None, 16): [(u, 9) for u in range(5)],
        ("lost", "public", 8): [(u, 1) for u in (1, 3, 5, 7, 9)],
        ("lost", "private", 8): [(u, 1) for u in (0, 2, 4, 6, 8)],
    }
    with pytest.raises(ValueError, match=r"'no_missing_pairs' failed: 16 bad, for example \[\(0, 1\), \(1, 1\)"):
        evaluate(submission.unionByName(extra), solution)
    twice = solution.unionByName(solution.filter("user_id < 3"))
    with pytest.raises(ValueError, match=r"'no_duplicates' failed: 3 bad, for example \[\(0, 1\), \(1, 1\), \(2, 1\)\]"):
        evaluate(submission, twice)
    with pytest.raises(ValueError, match="pairs without a prediction: .*'private': 8"):
        checks.raise_lost(found)
