from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ratewright import names as N
from ratewright.operators import aggregates, formation, keys, lookups, merge
from ratewright.operators.skew import find_heavy, salted_join

LOG = "user_id INT, book_id INT, has_read INT, rating DOUBLE, timestamp TIMESTAMP_NTZ"


def day(d, hour=0):
    return datetime(2024, 1, d, hour)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_anomalies_are_planned_items_with_a_rating(spark):
    log = spark.createDataFrame(
        [(1, 1, 0, 5.0, day(1)), (1, 2, 0, 0.0, day(1)), (1, 3, 1, 0.0, day(1)), (1, 4, None, 3.0, day(1)), (1, 5, 0, None, day(1))],
        LOG,
    )
    assert [r.book_id for r in formation.drop_anomalies(log).orderBy("book_id").collect()] == [2, 3, 4, 5]


def test_last_read_breaks_ties_and_ignores_planned_items(spark):
    log = spark.createDataFrame(
        [(1, 5, 1, 2.0, day(3)), (1, 9, 1, 4.0, day(3)), (1, 1, 0, 0.0, day(9)), (2, 1, 0, 0.0, day(1))], LOG
    )
    assert rows(formation.last_read(log)) == [(1, 9, 4.0, day(3))]


def test_warm_users_need_one_read_or_three_planned(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, 5.0, day(1))] + [(2, b, 0, 0.0, day(1)) for b in (1, 2, 3)] + [(3, b, 0, 0.0, day(1)) for b in (1, 2)], LOG
    )
    assert rows(formation.warm_users(log)) == [(1,), (2,)]


def test_solution_in_one_aggregation_equals_the_two_rules(spark):
    log = spark.createDataFrame(
        [(u, b, (u + b) % 2, float((u * b) % 11), day(1 + (u * b) % 28)) for u in range(40) for b in range(1, 9)], LOG
    )
    early, late = formation.time_chunks(log, day(15))
    stage = F.lit("public")
    fused = formation.form_solution(log, F.col("timestamp") <= day(15), F.col("timestamp") > day(15), stage)
    apart = formation.keep_warm(formation.last_read(late), formation.warm_users(early))
    assert rows(fused.select("user_id", "book_id", "rating")) == rows(apart.select("user_id", "book_id", "rating"))


def test_rated_counts_are_observed(spark):
    log = spark.createDataFrame([(1, 1, 1, 5.0, day(1)), (1, 2, 0, 0.0, day(1)), (1, 3, None, 0.0, day(1))], LOG)
    seen = Observation("rated")
    assert merge.keep_rated(log, seen).count() == 1
    assert seen.get == {"before": 3, "after": 1}


def test_union_fills_missing_columns_with_null(spark):
    train = spark.createDataFrame([(1, 2, 1, 5.0, day(1))], LOG)
    test = spark.createDataFrame([(1, 3)], "user_id INT, book_id INT")
    assert rows(merge.union_sources(train, test)) == [
        (1, 2, 1, 5.0, day(1), "train"), (1, 3, None, None, None, "test"),
    ]


def test_repeated_users_repeat_rows_but_repeated_books_do_not(spark):
    train = spark.createDataFrame([(1, 2, 1, 5.0, day(1))], LOG)
    test = spark.createDataFrame([], "user_id INT, book_id INT")
    users = spark.createDataFrame([(1, "1", 30.0), (1, "2", 40.0)], "user_id INT, gender STRING, age DOUBLE")
    books = spark.createDataFrame(
        [(2, "later", 1), (2, None, 0)], "book_id INT, title STRING, row_order INT"
    )
    merged = merge.merge_interactions(merge.union_sources(train, test), users, books, {})
    assert sorted(r.age for r in merged.collect()) == [30.0, 40.0]
    assert {r.title for r in merged.collect()} == {None}


def test_first_and_last_row_of_a_key(spark):
    data = spark.createDataFrame([(1, None, 0), (1, "b", 1), (1, "a", 2), (2, "c", 5)], "book_id INT, description STRING, row_order INT")
    assert rows(keys.keep_first(data, ["book_id"])) == [(1, None, 0), (2, "c", 5)]
    assert rows(lookups.last_descriptions(data)) == [(1, "a"), (2, "c")]
    assert rows(lookups.first_descriptions(data)) == [(1, ""), (2, "c")]


def test_shuffled_input_gives_the_same_first_rows(spark):
    data = spark.range(200).select((F.col("id") % 7).alias("book_id"), F.col("id").cast("string").alias("description"), F.col("id").alias("row_order"))
    mixed = data.orderBy(F.rand(3)).repartition(5)
    assert rows(keys.keep_first(data, ["book_id"])) == rows(keys.keep_first(mixed, ["book_id"]))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        keys.require_columns(spark.range(1), ["id", "other"])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 40).cast("int").alias("book_id"),
        F.col("id").alias("user_id"),
    )
    right = spark.createDataFrame([(k, k * 1.5) for k in [*range(0, 40, 2), 7, 7]], "book_id INT, value DOUBLE")
    heavy = find_heavy(left, ["book_id"], piece_rows=100)
    assert dict(heavy["book_id"])[7] >= 10
    assert None in dict(heavy["book_id"])
    split = salted_join(left, right, "book_id", how, ["user_id"], heavy=heavy)
    assert split.columns == left.columns + ([] if how in ("left_semi", "left_anti") else ["value"])
    assert rows(split) == rows(left.join(right, "book_id", how))


def test_split_join_spreads_the_heavy_key(spark):
    left = spark.range(8000).select(F.lit(1).alias("book_id"), F.col("id").alias("user_id"))
    right = spark.createDataFrame([(1, 2.0)], "book_id INT, value DOUBLE")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = salted_join(left, right, "book_id", "left", ["user_id"], heavy={"book_id": [(1, 64)]})
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(sizes) == 8000 and len(sizes) >= 6 and max(sizes) < 3000


def test_every_heavy_key_is_found(spark):
    rows = spark.range(3_000).selectExpr("id AS user_id", "explode(sequence(1, 3)) AS n")
    assert len(find_heavy(rows, ["user_id"], piece_rows=2)["user_id"]) == 3_000


def test_no_heavy_keys_in_even_data(spark):
    assert find_heavy(spark.range(1000).withColumnRenamed("id", "user_id"), ["user_id"]) == {"user_id": []}


def test_full_join_cannot_be_split(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), "id", "full", heavy={})


def test_aggregates_skip_missing_keys_and_leave_unknown_rows_empty(spark):
    schema = "user_id INT, book_id INT, author_id INT, rating DOUBLE"
    train = spark.createDataFrame([(1, 1, None, 4.0), (1, 2, 3, None), (2, 1, 3, 8.0)], schema)
    asked = spark.createDataFrame([(1, 9, None), (9, 1, 3)], "user_id INT, book_id INT, author_id INT")
    assert rows(aggregates.attach_rating_stats(asked, train, {})) == [
        (1, 9, None, 4.0, 1, None, None, None), (9, 1, 3, None, None, 6.0, 2, 8.0),
    ]
    genres = spark.createDataFrame([(1, 5), (1, 5), (1, None), (2, None)], "book_id INT, genre_id INT")
    assert rows(aggregates.genre_counts(genres)) == [(1, 2), (2, 0)]


def test_one_row_per_key_sorts_no_other_columns(spark, capsys):
    rows = [(k, i, f"text {i}") for i, k in enumerate([1, 1, 2, None, None, 3, 1, 2])]
    df = spark.createDataFrame(rows, "book_id INT, row_order BIGINT, description STRING")
    first, last = keys.keep_first(df, ["book_id"]), keys.keep_last(df, ["book_id"])
    assert sorted(r.row_order for r in first.collect()) == [0, 2, 3, 5]
    assert sorted(r.row_order for r in last.collect()) == [4, 5, 6, 7]
    last.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_split_join_leaves_columns_of_like_names_alone(spark):
    left = spark.createDataFrame([(1, i, 7) for i in range(20)] + [(None, 1, 8)], "user_id INT, key_pieces INT, Key_piece INT")
    right = spark.createDataFrame([(1, "a")], "user_id INT, key_piece_ STRING")
    found = salted_join(left, right, "user_id", heavy={"user_id": [(1, 4), (None, 2)]})
    assert found.columns == ["user_id", "key_pieces", "Key_piece", "key_piece_"]
    assert sorted(r.key_pieces for r in found.filter("key_piece_ = 'a'").collect()) == list(range(20)) and found.count() == 21
