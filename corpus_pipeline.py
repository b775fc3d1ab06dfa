"""The corpus pipeline: stages that each apply one training-data operator.

Documents that the quality classifier rejects go; one document of each near-duplicate
group stays; documents that contain a benchmark item go; personal data is replaced;
what is left is encoded by byte-level BPE and checked by decoding.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; extra columns of the input are dropped. Nulls, empty texts and empty tables
are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, decontamination, pii, quality_classifier, simhash
from marginalia.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored below the threshold go."""
    model = quality_classifier.fitted(docs, quality_classifier.learnable(table(spark, sf_dir, "labels")))
    return quality_classifier.scored(docs.select(*COLUMNS), model).where(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the document with the smallest doc_id of each group stays."""
    return simhash.deduplicate(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data becomes pseudonyms; n_chars is counted anew."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: numbers of tokens and hashes of ids and decoded bytes."""
    return byte_bpe.digests(docs)


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark", drop_benchmark),
    ("pii", replace_personal_data),
    ("tokens", tokenise),
]

#: SQL can express neither the learned stage nor the XXH64, keyed and BPE ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = durable(docs) if k < len(STAGES) - 1 else docs
    return docs
