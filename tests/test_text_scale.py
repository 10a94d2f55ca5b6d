"""Text features are made once per text, inside the row; fitted rows are dealt into tasks of bounded size."""

import inspect
from importlib import import_module

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import workflows
from ratewright import names as N
from ratewright.functions import terms, tokens
from ratewright.operators import boosting, lookups, matrix, tfidf

training = import_module("ratewright.plans.train")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    rows = [(1, "red fox red fox", 0), (2, None, 0), (None, "red dog", 0), (3, "fox", 0), (3, "red red dog", 1)]
    return spark.createDataFrame(rows, "book_id INT, description STRING, row_order INT")


def test_terms_find_the_tokens_of_a_text_once(spark):
    found = texts(spark).select(terms(tokens(F.col(N.DESCRIPTION))).alias("t"))
    assert optimized(found).count("regexp_extract_all") == 1
    assert sorted(map(len, (r.t for r in found.collect()))) == [0, 1, 3, 5, 7]
    missing = spark.range(1).select(terms(F.lit(None).cast("array<string>")).alias("t")).first()
    assert missing.t is None


def test_vocabulary_finds_the_terms_of_a_text_once(spark):
    assert optimized(tfidf.fit_vocabulary(texts(spark), 5, 1, 1.0)).count("regexp_extract_all") == 1


def test_weights_hold_one_text_at_a_time(spark):
    """No aggregation, sort or window over the words of all texts."""
    vocabulary = tfidf.fit_vocabulary(texts(spark), 50, 1, 1.0)
    found = tfidf.tfidf_weights(texts(spark).filter("row_order = 0"), vocabulary)
    plan = optimized(found)
    assert "Aggregate" not in plan and "Window" not in plan and "Join" not in plan


def test_weights_of_missing_books_other_numbers_and_no_vocabulary(spark):
    last = lookups.last_descriptions(texts(spark))
    vocabulary = spark.createDataFrame([("red", 40, 1.0), ("dog", 7, 2.0)], "term STRING, idx BIGINT, idf DOUBLE")
    found = {(r.book_id, r.idx): r.weight for r in tfidf.tfidf_weights(last, vocabulary).collect()}
    root = 8**0.5
    expected = {(1, 40): 1.0, (None, 40): 1 / 5**0.5, (None, 7): 2 / 5**0.5, (3, 40): 2 / root, (3, 7): 2 / root}
    assert found == pytest.approx(expected)
    none = tfidf.tfidf_weights(last, vocabulary.limit(0))
    assert none.collect() == [] and none.columns == [N.BOOK, "idx", "weight"]


def test_entries_of_a_vector_too_wide_to_be_made_dense(spark):
    schema = T.StructType([T.StructField("v", VectorUDT())])
    rows = [(Vectors.sparse(2_000_000_000, [3, 1_999_999_999], [0.5, 2.0]),), (Vectors.dense([7.0, 0.0]),), (Vectors.dense([]),), (None,)]
    found = spark.createDataFrame(rows, schema).select(tfidf.vector_entries(F.col("v")).alias("e")).collect()
    assert [None if r.e is None else [tuple(e) for e in r.e] for r in found] == [[(3, 0.5), (1_999_999_999, 2.0)], [(0, 7.0), (1, 0.0)], [], None]
    assert "vector_to_array" not in inspect.getsource(workflows)


def test_boosting_queries_deal_their_rows_into_bounded_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(boosting, "fit_boosting", lambda train, late, settings: seen.append(train))
    monkeypatch.setattr(workflows, "rows_per_partition", lambda n: 100)
    rows = spark.range(1_000).select(F.col("id").alias(N.USER), F.col("id").alias(N.BOOK), F.lit(1.0).alias(N.RATING))
    early = workflows._parities(None, rows).select(*N.PAIR, N.RATING, matrix.FEATURES).coalesce(1)
    workflows._fitted(early, early, workflows.STUMPS)
    assert seen[0].rdd.getNumPartitions() == 10 and seen[0].count() == 1_000 and seen[0].columns == early.columns


def test_wide_rows_go_to_more_tasks():
    assert training.rows_per_partition(2) > 100_000
    assert 20_000 // training.rows_per_partition(10_085) >= 12
    assert training.rows_per_partition(10**9) == 1
