"""Streaming queries, run to the end of what is there and read back as tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..operators import activity as A
from ..session import listed_in_bulk, small_files
from ..sources import sinks
from ..sources.vault import derived_vault
from ..streaming import activity as S
from ..streaming.tables import StateTable
from .activity import ROWS
from .base import Queries, over_notes

Q = Queries()


def ran(stream: DataFrame, put, mode: str) -> None:
    """Everything that the stream gives now, batch by batch."""
    path = sinks.shared_path(stream.sparkSession)
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Everything that the stream gives now, as a table in the shared folder: the rows that were
    appended, the last complete table, or the last row of each key."""
    spark, path, done = stream.sparkSession, sinks.shared_path(stream.sparkSession), []
    if mode == "update":
        return merged(stream, S.upserted(spark, path, keys), mode)
    put = S.appended(path)

    def batch(rows: DataFrame, epoch: int) -> None:
        put(rows, epoch)
        done.append(epoch)

    ran(stream, batch, mode)
    kept = done if mode == "append" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*(f"{path}/{epoch}" for epoch in kept)) if kept else spark.createDataFrame([], stream.schema)


def merged(stream: DataFrame, table: StateTable, mode: str = "append") -> DataFrame:
    """The table that all batches are merged into."""
    ran(stream, table.add, mode)
    rows = table.rows()
    return rows if rows is not None else stream.sparkSession.createDataFrame([], stream.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files copied below a folder, as a stream source reads folders."""
    path = sinks.shared_path(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(path)
    return S.stream_activity(spark, path)


def on(name, run, sql=None):
    Q.plain(name, lambda spark, sf_dir: run(_events(spark, sf_dir)), sql and ROWS + sql)


on("stream_visit_counts", lambda s: drained(S.visit_counts(s), "complete"), "select path, count(*) as visits from act group by path")
on("stream_daily", lambda s: drained(S.per_period(s), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n"), "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from act group by 1")
on("stream_monthly", lambda s: drained(S.per_month(s), "complete").select(F.date_format("start", "yyyy-MM").alias("month"), "n"), "select strftime(ts, '%Y-%m') as month, count(*) as n from act group by 1")
on("stream_progress", lambda s: S.progress_told(merged(S.progress_rows(s), S.progress(s.sparkSession, sinks.shared_path(s.sparkSession)))), 'select "user", path, percent, duration, percent >= 95 as completed from prog')
on("stream_dedup", lambda s: drained(S.dedup(s, ["event_id"]), "append").agg(F.count("*").alias("n")), "select count(distinct event_id) as n from act")
on("stream_keep_last_n", lambda s: merged(s, S.keep_last_n(s.sparkSession, sinks.shared_path(s.sparkSession), 5)).select("event_id"), 'select event_id from act qualify row_number() over (partition by "user" order by ts desc, event_id desc) <= 5')


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses are counted as a stream, then told to their links, one row a link, as another."""
    accesses = _events(spark, sf_dir).select("path", "ts", F.lit(1).cast("long").alias("n"))
    counts = merged(accesses, S.access_counts(spark, sinks.shared_path(spark))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    links = A.shares(A.activity(spark, sf_dir))
    hits = links.select("token", "created_at", "expires_at", "max_visits").dropDuplicates(["token"]).join(A.valid_visits(links, counts), "token")
    path = sinks.shared_path(spark)
    told = hits.select("token", F.col("created_at").cast("timestamp").alias("ts"), "n", F.col("expires_at").cast("timestamp").alias("expires_at"), F.col("max_visits").cast("double").alias("max_visits"))
    told.write.parquet(path)
    stream = spark.readStream.schema(told.schema).parquet(path)
    return drained(S.share_budget(stream), "update", ["token"]).where("visits > 0")


Q.plain("stream_share_budget", _budget, ROWS + "select token, least(count(event_id), coalesce(max_visits, count(event_id)))::bigint as visits from shares s join (select path, ts, event_id from act) a on a.path = s.path and a.ts >= s.created_at and (expires_at is null or a.ts <= expires_at) group by token, max_visits having visits > 0")


#: Files of a folder that is streamed at once: the driver lists them and keeps their names while the stream runs.
FILES = 50_000
#: Folders that are streamed at once: the driver lists one while the tasks read another.
STREAMS = 2


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes as files in folders of about ``FILES``, streamed ``STREAMS`` folders at a time and merged into one table."""
    vault, root = derived_vault(spark, sf_dir), sinks.shared_path(spark)
    part = F.pmod(F.xxhash64("path"), F.lit(max(-(-vault.count() // FILES), 1))).cast("string")
    sinks.write_notes(vault.withColumn("path", F.concat(part, F.lit("/"), "path")), root)
    table, folders = S.merge_notes(spark, sinks.shared_path(spark)), sorted(r[0] for r in vault.select(part).distinct().collect())  # a row a folder
    turn, order = Lock(), {}

    def streamed(folder: str) -> None:
        def add(rows: DataFrame, epoch: int) -> None:
            with turn:  # the table takes a batch at a time; no path is in two folders, so any order will do
                table.add(rows, order.setdefault((folder, epoch), len(order)))

        ran(S.stream_notes(spark, f"{root}/{folder}"), add, "append")

    with small_files(spark), listed_in_bulk(spark):
        with ThreadPoolExecutor(STREAMS) as pool:
            list(pool.map(lambda run: run(), [inheritable_thread_target(spark)(partial(streamed, folder)) for folder in folders]))
        told = table.rows(lambda rows: rows.select("path", "epoch", F.length("raw").alias("chars"))) if folders else spark.createDataFrame([], "path string, chars int")
    below = F.regexp_replace(F.substring_index("path", f"/{root.rsplit('/', 1)[-1]}/", -1), "^[0-9]+/", "")
    return told.select(below.alias("path"), "chars")


Q.plain("stream_notes", _notes, over_notes("select path, length(raw) as chars from notes"))
