"""The models of op5 learn from up to 1,200 toxic and 1,500 ordinary texts, in grams of nine letters."""

from pyspark.sql import functions as F

from ratewright.llm import toxicity


def test_sample_takes_all_texts_within_the_bounds(spark):
    rows = spark.range(2_800).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), (F.col("id") % 2).alias("toxic"))
    bounds = toxicity.FIT_TOXIC, toxicity.FIT_ORDINARY
    sample = toxicity.labelled_sample(rows, rows.select("doc_id", "toxic"), "doc_id", "text", "toxic", *bounds)
    asked = rows.filter(~toxicity.held_out(F.col("doc_id")))
    assert asked.count() > 2_000 and sample.count() == asked.count()
    assert (toxicity.grams(["a" * 20])[0] > 0).sum(axis=1).max() == toxicity.ORDER == 9
