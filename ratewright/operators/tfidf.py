"""TF-IDF of descriptions: vocabulary, weights in long form, and sparse vectors for the learner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import names as N
from ..functions import once, terms, tokens


def fit_vocabulary(
    descriptions: DataFrame,
    max_features: int = N.TFIDF_MAX_FEATURES,
    min_df: int = N.TFIDF_MIN_DF,
    max_df: float = N.TFIDF_MAX_DF,
) -> DataFrame:
    """Terms `(term, idx, tf, df, idf)` of the given texts, one text per row.

    Each text sorts its own terms, so a term that differs from its predecessor is new in that text. Term and document
    frequency then come out of one aggregation by term, combined before its shuffle, without any key for the document.
    Terms in fewer than `min_df` rows or in more than the share `max_df` of rows go first; of the rest the most frequent
    stay, ties in alphabetical order. The index is the alphabetical rank.
    """
    docs = descriptions.select(F.sort_array(terms(tokens(F.col(N.DESCRIPTION)))).alias("term"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.col("term"))
    seen = (
        docs.select("term", shifted.alias("previous"))
        # The outer form, as Spark tests the array of the plain one beforehand and makes all terms again for that.
        .select(F.inline_outer(F.arrays_zip("term", "previous")))
        .filter(F.col("term").isNotNull())
    )
    n_docs = descriptions.agg(F.count("*")).scalar()
    counted = seen.groupBy("term").agg(
        F.count("*").alias("tf"), F.count_if(~F.col("term").eqNullSafe(F.col("previous"))).alias("df")
    )
    kept = (
        counted.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
        .orderBy(F.col("tf").desc(), "term")
        .limit(max_features)
    )
    # At most `max_features` rows are left, so ranking them in one task is bounded.
    rank = F.row_number().over(Window.orderBy("term")).cast("bigint") - 1
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return kept.select("term", rank.alias("idx"), "tf", "df", idf.alias("idf"))


def tfidf_weights(descriptions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Weights `(book_id, idx, weight)` of one text per book; each book's weights have length one.

    They are the entries of the book's sparse vector, which is made inside the row: whatever the number of texts in a task,
    it holds the terms of one at a time, and nothing is shuffled. The vocabulary comes to the driver, as for the vectors.
    """
    entries = vocabulary.select("term", "idx", "idf").orderBy("idx").collect()
    if not entries:
        kinds = f"struct<idx:{vocabulary.schema['idx'].dataType.simpleString()},weight:double>"
        return descriptions.select(N.BOOK, F.inline(F.lit(None).cast(f"array<{kinds}>")))
    found = vector_entries(F.col(N.TFIDF))
    # The outer form, as Spark tests the array of the plain one beforehand and makes the vector again for that.
    rows = _vectors(descriptions, entries).select(N.BOOK, F.inline_outer(found)).filter(F.col("idx").isNotNull())
    numbers = [e.idx for e in entries]
    idx = F.col("idx") if numbers == list(range(len(numbers))) else F.get(F.lit(numbers), F.col("idx"))
    return rows.select(N.BOOK, idx.cast(vocabulary.schema["idx"].dataType).alias("idx"), F.col("value").alias("weight"))


def vector_entries(vector: Column) -> Column:
    """The entries of a vector as an array of `(idx, value)`; of a sparse one only those that it stores."""

    def entries(v: Column) -> Column:
        places = F.coalesce(v["indices"], F.transform(v["values"], lambda _, i: i))
        return F.zip_with(places, v["values"], lambda i, x: F.struct(i.alias("idx"), x.alias("value")))

    return once(F.unwrap_udt(vector), entries)


def tfidf_vectors(
    descriptions: DataFrame, vocabulary: DataFrame, max_features: int = N.TFIDF_MAX_FEATURES
) -> DataFrame:
    """The same weights as one sparse vector per book `(book_id, tfidf)`, computed inside the row by MLlib.

    The vocabulary comes to the driver, which is safe because it holds at most `max_features` entries.
    """
    entries = vocabulary.select("term", "idx", "idf").orderBy("idx").take(max_features + 1)
    if not entries:
        raise ValueError("the vocabulary is empty")
    if len(entries) > max_features:
        raise ValueError(f"the vocabulary holds more than {max_features} terms")
    return _vectors(descriptions, entries)


def _vectors(descriptions: DataFrame, entries: Sequence[Row]) -> DataFrame:
    docs = descriptions.select(N.BOOK, terms(tokens(F.col(N.DESCRIPTION))).alias("terms"))
    counts = CountVectorizerModel.from_vocabulary([e.term for e in entries], inputCol="terms", outputCol="counts")
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense([e.idf for e in entries]), inputCol="counts", outputCol="scaled"
    )
    unit = Normalizer(p=2.0, inputCol="scaled", outputCol=N.TFIDF)
    return unit.transform(scaled.transform(counts.transform(docs))).select(N.BOOK, N.TFIDF)
