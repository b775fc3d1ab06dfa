"""Operator 10: quality classifier, a byte-level convolutional network in numpy.

Learned filters slide over overlapping chunks that cover the whole document; each
filter's largest value in a chunk feeds a softmax, and the chunks' probabilities are
averaged into one. The network is fitted to a bounded sample of labelled rows
(``per_label`` documents of either label).

Null and empty texts score 0. Without rows of both labels every text scores 1, so that
nothing is rejected. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecnn import ByteCNN
from .common import spare, table
from .labelled import id_remainder, score, train

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and label of the labelled rows outside the held-out fold."""
    return labels.where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col("quality").alias("label"))


def fitted(docs: DataFrame, ids: DataFrame, per_label: int = 1500) -> ByteCNN | None:
    """A network for doc_id and text with the labels of ``ids``; None if they tell nothing apart."""
    model = train(docs.select("doc_id", "text"), ids, per_label)
    return model if model and len(model.labels) > 1 and "1" in model.labels else None


def scored(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """The same rows with ``score``, the probability of label 1 (an input column of that name is replaced)."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(1.0))
    told = spare(docs, "told")
    return score(docs, model, told).withColumn("score", F.least(F.col(told)[model.labels.index("1")], F.lit(1.0))).drop(told)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, learnable(table(spark, sf_dir, "labels")))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
