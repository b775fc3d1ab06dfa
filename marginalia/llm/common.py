"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java class body.
WS = r"\x20\x09-\x0D"
#: Bytes of an Arrow batch of whole texts. A task holds a batch several times over, in the JVM's buffers
#: and in its Python worker, and neither gives all of it back; Spark's own bound is 64 MB.
ARROW_BYTES = 4 << 20
#: Characters that never belong to a lower-case ASCII-or-beyond word.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where it names none, one in the warehouse,
    which executors share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder, for what is large or read
    by column. It stays there until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches hold about ``ARROW_BYTES`` from now on, unless the session names a size of its own.
    Spark reads the setting when a query runs, so it has to stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(ARROW_BYTES))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case so that only A-Z become a-z: the two characters outside ASCII
    whose lower case reaches into ASCII are replaced first."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def only_a_z_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column, separators: str) -> Column:
    """Non-empty pieces of text between runs of separators; null text gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def space_words(text: Column) -> Column:
    return split_words(text, f"[{WS}]+")


def word_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of every run of ``size`` consecutive words, in order. ``words``
    must be a plain column: the lambda reads it by index."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(size - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(words[i + k] for k in range(1, size))),
    )
