"""Operator 7: language identification by a byte convolutional network.

Filters of widths two to six with max pooling and a softmax layer, trained in numpy
on a bounded labelled sample (``per_label`` documents a language), then applied to
windows of fixed length that cover the whole text. A text's prediction is the
largest mean probability over its windows.

Null texts and texts without a letter are ``und`` with score 0; so is every text if
no row is labelled. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import id_remainder, score, train


def identify(docs: DataFrame, learn_from: DataFrame, per_label: int = 1200) -> DataFrame:
    """doc_id, lang_pred, score; ``learn_from`` has doc_id and lang of the rows to learn from."""
    model = train(docs, learn_from.select("doc_id", F.col("lang").alias("label")), per_label)
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    told = score(lettered, model)
    best = F.array_max("probabilities")
    names = F.array(*(F.lit(x) for x in model.labels))
    return told.select(
        "doc_id",
        F.when(F.col("lettered"), F.element_at(names, F.array_position("probabilities", best).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.least(best, F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    told = identify(docs.select("doc_id", "text"), docs.where(~held_out).select("doc_id", "lang"))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
