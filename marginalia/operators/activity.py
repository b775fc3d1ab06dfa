"""Reader activity: progress, history, favourites, share links, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user, path, action, ts, amount from the events table; the note is the k of props."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    return events.select("event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("Doc "), k).alias("path"), F.col("event_type").alias("action"), "ts", F.col("value").alias("amount"))


def progress(rows: DataFrame) -> DataFrame:
    """Per user and note: the latest percentage, all durations, whether it is read."""
    last = F.max(F.struct("ts", "event_id", F.least("amount", F.lit(100.0)).alias("percent"))).alias("last")
    told = rows.groupBy("user", "path").agg(last, F.round(F.sum("amount"), 4).alias("duration"))
    return told.select("user", "path", F.col("last.ts").alias("last_read"), F.col("last.percent").alias("percent"), "duration", (F.col("last.percent") >= 95).alias("completed"))


def user_progress(table: DataFrame, user: str, limit: int = 20) -> DataFrame:
    return table.where(F.col("user") == user).orderBy(F.desc("last_read"), "path").limit(limit)


def user_history(rows: DataFrame, user: str, limit: int = 50) -> DataFrame:
    return rows.where(F.col("user") == user).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("user", "path", "ts", "amount")


def keep_last_n(rows: DataFrame, n: int = 200) -> DataFrame:
    """The newest n rows of each user; a bounded top-n before the shuffle."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("n") <= n).drop("n")


def visit_counts(rows: DataFrame, limit: int = 10) -> DataFrame:
    counted = rows.groupBy("path").agg(F.count("*").alias("visits"), F.min_by("user", F.struct("user", "ts", "event_id")).alias("first_user"))
    return counted.orderBy(F.desc("visits"), "path").limit(limit)


def recent_distinct(rows: DataFrame, n: int = 10) -> DataFrame:
    """Each user's n latest distinct notes."""
    last = rows.groupBy("user", "path").agg(F.max("ts").alias("ts"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), "path"))).where(F.col("place") <= n)


def favorites(actions: DataFrame) -> DataFrame:
    """user, path of what each user's latest add or remove left in the set."""
    return actions.groupBy("user", "path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op")).where("op = 'add'").select("user", "path")


def delete_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def shares(rows: DataFrame) -> DataFrame:
    """Share links derived from activity: every tenth event creates one."""
    t = F.col("event_id")
    return rows.where(t % 10 == 0).select(
        F.concat(F.lit("s"), t.cast("string")).alias("token"), "path", F.col("user").alias("creator"), F.col("ts").alias("created_at"),
        F.when(t % 20 == 0, F.col("ts") + F.expr("interval 3 days")).alias("expires_at"), F.when(t % 30 == 0, (t % 7).cast("int")).alias("max_visits"), (t % 9).cast("int").alias("visit_count"),
    )


def share_status(links: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    bad = F.coalesce(now > F.col("expires_at"), F.lit(False)) | F.coalesce(F.col("visit_count") >= F.col("max_visits"), F.lit(False))
    return links.withColumn("valid", ~bad)


def access_counts(accesses: DataFrame) -> DataFrame:
    """path, ts, n: how many accesses a note had at each moment."""
    return accesses.groupBy("path", "ts").agg(F.count("*").alias("n"))


def valid_visits(links: DataFrame, counts: DataFrame) -> DataFrame:
    """token, n: the accesses of ``counts`` (path, ts, n) from creation to expiry, for tokens
    with known path and creation.

    They are the difference of the running counts at both ends of a link. A running count is
    that of the hours before, from one row per path and hour, and that within the hour.
    """
    told = links.where("path is not null and created_at is not null and (expires_at is null or expires_at >= created_at)")
    # at one moment a creation stands before the accesses, an expiry after them
    ends = F.explode(F.array(F.struct(F.col("created_at").alias("ts"), F.lit(-1).alias("place")), F.struct(F.col("expires_at").alias("ts"), F.lit(1).alias("place"))))
    marks = told.select("token", "path", F.col("expires_at").isNull().alias("open"), ends.alias("e")).select("path", "e.ts", "e.place", F.lit(0).cast("long").alias("n"), "token", "open").where("ts is not null")
    known = counts.where("path is not null and ts is not null").select("path", "ts", F.lit(0).alias("place"), "n", F.lit(None).cast("string").alias("token"), F.lit(False).alias("open"))
    rows = known.unionByName(marks).withColumn("hour", F.date_trunc("hour", "ts"))
    by_path = Window.partitionBy("path")
    hours = rows.groupBy("path", "hour").agg(F.sum("n").alias("n")).select(
        "path", "hour", F.coalesce(F.sum("n").over(by_path.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by_path).alias("total"),
    )
    within = F.sum("n").over(Window.partitionBy("path", "hour").orderBy("ts", "place").rowsBetween(Window.unboundedPreceding, 0))
    reached = rows.withColumn("within", within).where(F.col("place") != 0).join(hours, ["path", "hour"]).withColumn("reached", F.col("before") + F.col("within"))
    worth = F.when(F.col("place") > 0, F.col("reached")).when(F.col("open"), F.col("total") - F.col("reached")).otherwise(-F.col("reached"))
    return reached.groupBy("token").agg(F.sum(worth).alias("n"))


def share_visits(links: DataFrame, accesses: DataFrame) -> DataFrame:
    """token, visits: accesses before expiry, up to max_visits."""
    told = links.select("token", "max_visits").join(valid_visits(links, access_counts(accesses)), "token", "left")
    return told.select("token", F.least(F.coalesce("n", F.lit(0)), F.coalesce(F.col("max_visits").cast("long"), F.coalesce("n", F.lit(0)))).alias("visits"))


def shares_by(links: DataFrame, column: str, value: str) -> DataFrame:
    return links.where(F.col(column) == value).orderBy("token")


def shares_cleanup(links: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The links that stay, and how many go."""
    told = share_status(links, as_of)
    return told.where("valid").drop("valid"), told.agg(F.count_if(~F.col("valid")).alias("removed"))


def runs_last(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def duration_histogram(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """Cumulative counts at each bound, with the sum and the count of all."""
    sums = [F.count_if(F.col("amount") <= b).alias(f"le{i}") for i, b in enumerate(bounds)]
    one = rows.agg(*sums, F.count("*").alias("total"), F.round(F.sum("amount"), 2).alias("amount"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"le{i}").alias("n")) for i, b in enumerate(bounds)))
    return one.select(F.explode(cells).alias("c"), "total", "amount").select("c.le", "c.n", "total", "amount")


def op_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("action").agg(F.count("*").alias("n"))


def user_directory(rows: DataFrame) -> DataFrame:
    """Users with role and state, and when they were last seen."""
    number = F.substring("user", 5, 20).cast("long")
    told = rows.groupBy("user").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n_actions"))
    return told.select("user", F.when(number % 10 == 0, "admin").otherwise("reader").alias("role"), (number % 13 != 0).alias("enabled"), "last_seen", "n_actions")
