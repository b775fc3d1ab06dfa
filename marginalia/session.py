"""A session with the settings the operators expect."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; everything else is the caller's or the cluster's."""
    builder = SparkSession.builder.appName("marginalia")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where it names none, the warehouse, which
    executors share too."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """What is run inside is planned with this setting."""
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def planned_ahead(spark: SparkSession):
    """What is run inside is planned as a whole before it runs: only then does a checkpoint tell how its
    rows are dealt, and a later join needs no exchange for them."""
    return setting(spark, "spark.sql.adaptive.enabled", "false")


def small_files(spark: SparkSession):
    """A task reads hundreds of small files rather than a few, and the driver tells of fewer tasks."""
    return setting(spark, "spark.sql.files.openCostInBytes", "65536")


@contextmanager
def listed_in_bulk(spark: SparkSession) -> Iterator[None]:
    """A list of many paths is looked up by a few tasks a core, and the driver forgets it with its reader. Spark's own setting is
    up to 10,000 tasks, a few paths each, and a cache of up to 250 MB; a stream looks up the files of each batch so, once."""
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks), setting(spark, "spark.sql.hive.filesourcePartitionFileCacheSize", "0"):
        yield


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes folders, wherever Spark's file systems keep them; what is not there is none."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
