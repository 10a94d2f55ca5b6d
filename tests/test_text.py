import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.functions import masked_mean, terms, tokens
from ratewright.operators import embeddings, lookups, tfidf

DOCS = [
    "the quick brown fox", "The quick dog, the lazy dog", "", None, "a b c", "один", "Один два два_3 день", "the the the end",
    "quick", "brown fox jumps over the lazy dog 42",
]


def python_terms(text):
    words = re.findall(r"\w\w+", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def frame(spark, docs):
    return spark.createDataFrame([(i, d, 0) for i, d in enumerate(docs)], "book_id INT, description STRING, row_order INT")


def brute_vocabulary(docs, max_features, min_df, max_df):
    per_doc = [Counter(python_terms(d)) for d in docs]
    tf, df = Counter(), Counter()
    for c in per_doc:
        tf.update(c)
        df.update(c.keys())
    kept = [t for t in tf if min_df <= df[t] <= max_df * len(docs)]
    kept = sorted(sorted(kept, key=lambda t: (-tf[t], t))[:max_features])
    return {t: (i, tf[t], df[t], math.log((1 + len(docs)) / (1 + df[t])) + 1) for i, t in enumerate(kept)}


def test_terms_of_short_and_foreign_texts(spark):
    got = frame(spark, DOCS).select("book_id", terms(tokens(F.col("description"))).alias("t")).collect()
    assert {r.book_id: r.t for r in got} == {i: python_terms(d) for i, d in enumerate(DOCS)}


@pytest.mark.parametrize(("max_features", "min_df", "max_df"), [(1000, 1, 1.0), (5, 2, 0.95), (3, 1, 0.4)])
def test_vocabulary_against_brute_force(spark, max_features, min_df, max_df):
    got = tfidf.fit_vocabulary(frame(spark, DOCS), max_features, min_df, max_df).collect()
    expected = brute_vocabulary(DOCS, max_features, min_df, max_df)
    assert {r.term: (r.idx, r.tf, r.df) for r in got} == {t: v[:3] for t, v in expected.items()}
    assert all(abs(r.idf - expected[r.term][3]) < 1e-12 for r in got)


def test_repeated_texts_count_in_every_row(spark):
    got = tfidf.fit_vocabulary(frame(spark, ["same text", "same text", "other"]), 10, 2, 1.0).collect()
    assert {r.term: r.df for r in got} == {"same": 2, "text": 2, "same text": 2}


def test_weights_have_unit_length_and_equal_the_vectors(spark):
    docs = frame(spark, DOCS)
    vocabulary = tfidf.fit_vocabulary(docs, 12, 1, 1.0)
    texts = lookups.last_descriptions(docs)
    long = {}
    for r in tfidf.tfidf_weights(texts, vocabulary).collect():
        long.setdefault(r.book_id, {})[r.idx] = r.weight
    for row in long.values():
        assert abs(sum(w * w for w in row.values()) - 1) < 1e-12
    expected = brute_vocabulary(DOCS, 12, 1, 1.0)
    for r in tfidf.tfidf_vectors(texts, vocabulary).collect():
        sparse = dict(zip(r.tfidf.indices.tolist(), r.tfidf.values.tolist()))
        assert sparse == pytest.approx(long.get(r.book_id, {}))
        raw = {expected[t][0]: n * expected[t][3] for t, n in Counter(python_terms(DOCS[r.book_id])).items() if t in expected}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1
        assert sparse == pytest.approx({i: v / norm for i, v in raw.items()})


def test_empty_vocabulary_is_an_error(spark):
    docs = frame(spark, ["one text", "two words"])
    with pytest.raises(ValueError, match="empty"):
        tfidf.tfidf_vectors(docs, tfidf.fit_vocabulary(docs, 10, 2, 1.0))


def test_weights_shuffle_only_to_pick_the_texts(spark, capsys):
    docs = frame(spark, DOCS)
    vocabulary = spark.createDataFrame([("the", 0, 1.0)], "term STRING, idx BIGINT, idf DOUBLE").limit(10).cache()
    vocabulary.count()
    tfidf.tfidf_weights(lookups.last_descriptions(docs), vocabulary).explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    vocabulary.unpersist()
    assert plan.count("Exchange hashpartitioning") == 1


def test_masked_mean_in_both_forms(spark):
    docs = [
        (1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]),
        (2, [[1.0, 2.0], [3.0, 4.0]], [0, 0]),
        (3, [[5.0, 7.0]], [1]),
    ]
    df = spark.createDataFrame(docs, "doc INT, hidden ARRAY<ARRAY<DOUBLE>>, mask ARRAY<INT>")
    expected = {1: [2.0, 3.0], 2: [0.0, 0.0], 3: [5.0, 7.0]}
    assert {r.doc: r.m for r in df.select("doc", masked_mean(F.col("hidden"), F.col("mask")).alias("m")).collect()} == expected
    long = df.select("doc", "mask", F.posexplode("hidden").alias("pos", "v")).select(
        "doc", F.expr("element_at(mask, pos + 1)").alias("mask"), F.posexplode("v").alias("dim", "value")
    )
    got = {(r.doc, r.dim): r.pooled for r in embeddings.pool_tokens(long, "doc").collect()}
    assert got == {(d, i): v for d, vs in expected.items() for i, v in enumerate(vs)}


def length_encoder():
    """A factory that travels to the workers by value: they cannot import this file."""

    def make():
        import numpy

        def encode(texts):
            assert len(texts) <= 3
            width = max(1, *(len(t) for t in texts), 1)
            mask = numpy.zeros((len(texts), width))
            hidden = numpy.zeros((len(texts), width, 2))
            for i, t in enumerate(texts):
                mask[i, : len(t)] = 1
                hidden[i, : len(t), 0] = len(t)
                hidden[i, : len(t), 1] = 1
                hidden[i, len(t) :, 1] = 99
            return hidden, mask

        return encode

    return make


def test_encoding_pools_batches_and_skips_cached_books(spark):
    docs = frame(spark, ["abcd", None, "xy", "z", "cached"])
    cache = spark.createDataFrame([(4, [0.5, 0.5])], "book_id INT, embedding ARRAY<FLOAT>")
    todo = embeddings.books_to_encode(lookups.first_descriptions(docs), cache)
    got = embeddings.encode_books(todo, length_encoder(), batch_size=3, tasks=2)
    assert {r.book_id: r.embedding for r in got.collect()} == {0: [4.0, 1.0], 1: [0.0, 0.0], 2: [2.0, 1.0], 3: [1.0, 1.0]}
    rows = spark.createDataFrame([(1, 0), (1, 77)], "user_id INT, book_id INT")
    found = {r.book_id: r.embedding for r in lookups.attach_embeddings(rows, got, {}, dim=2).collect()}
    assert found == {0: [4.0, 1.0], 77: [0.0, 0.0]}
    assert np.isfinite(list(found.values())).all()
