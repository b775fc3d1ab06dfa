"""Stream tables by bucket against plain Python, and per-key timers."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.plans import streaming
from marginalia.streaming import activity as S
from marginalia.streaming.tables import StateTable, last, newest

ROW = "user string, event_id long, ts timestamp, v long"


def batches(n: int, size: int, users: int = 9):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    made = [(rng.choice([*(f"u{k}" for k in range(users)), "hot", "hot", None]), e, start + timedelta(hours=rng.randrange(40)), rng.randrange(100)) for e in range(n * size)]
    return [made[k * size : (k + 1) * size] for k in range(n)]


def top(rows, n):
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return sorted((r for held in by.values() for r in sorted(held, key=lambda r: (r[2], r[1]), reverse=True)[:n]), key=str)


def told(table: StateTable) -> list:
    return sorted(map(tuple, table.rows().select("user", "event_id", "ts", "v").collect()), key=str)


@pytest.mark.parametrize("fan", [2, 3, 99])
def test_keep_last_n_over_batches(spark, tmp_path, fan):
    table = StateTable(spark, str(tmp_path / "t"), ["user"], newest(["user"], 3, F.desc("ts"), F.desc("event_id")), buckets=4, fan=fan)
    assert table.rows() is None
    seen = []
    for epoch, rows in enumerate([*batches(5, 40), []]):
        for _ in range(2 if epoch in (2, 4) else 1):  # a batch that runs again changes nothing
            table.add(spark.createDataFrame(rows, ROW), epoch)
        seen += rows
        assert told(table) == top(seen, 3)
    files = json.loads(spark.read.parquet(str(tmp_path / "t" / "marks")).orderBy(F.desc("epoch")).first()["mark"])["files"]
    assert all(len(fs) < max(fan, 6) for fs in files.values())


def test_last_row_by_key_and_files_that_go(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ["user"], last(["user"], "event_id"), buckets=3, fan=2)
    want = {}
    for epoch, rows in enumerate(batches(6, 12)):
        table.add(spark.createDataFrame(rows, ROW), epoch)
        want |= {r[0]: r for r in sorted(rows, key=lambda r: r[1])}
        assert told(table) == sorted(want.values(), key=str)
    left = {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").glob("*/bucket=*") if list(p.glob("*.parquet"))}
    mark = json.loads(spark.read.parquet(str(tmp_path / "t" / "marks")).orderBy(F.desc("epoch")).first()["mark"])
    assert left == {f for fs in mark["files"].values() for f in fs} | {*mark["gone"]}


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    """A small batch on a large table writes its own rows, and no bucket that it does not touch."""
    table = StateTable(spark, str(tmp_path / "t"), ["user"], newest(["user"], 100_000, F.desc("event_id")), buckets=16, fan=4)
    table.add(spark.range(60_000).selectExpr("concat('u', id % 500) as user", "id as event_id", "timestamp'2024-01-01' as ts", "id as v"), 0)
    size = lambda: sum(f.stat().st_size for f in Path(tmp_path / "t").rglob("*.parquet"))
    before = size()
    for epoch in (1, 2):
        table.add(spark.createDataFrame([("u3", 10**9 + epoch, None, 1)], ROW), epoch)
    assert size() - before < before / 20
    assert table.rows().count() == 60_002


ACCESS = "token string, ts timestamp, n long, expires_at timestamp, max_visits double"


def budget(spark, path, rows, checkpoint, progress):
    """Each row is a batch of its own."""
    for t, at, n, end, most in rows:
        one = spark.createDataFrame([(t, at, n, end, most)], "token string, ts string, n long, expires_at string, max_visits double")
        one.selectExpr("token", "cast(ts as timestamp) ts", "n", "cast(expires_at as timestamp) expires_at", "max_visits").coalesce(1).write.mode("append").parquet(f"{path}/in")
    table = S.upserted(spark, f"{path}/out", ["token"])
    stream = S.share_budget(spark.readStream.schema(ACCESS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    query = stream.writeStream.foreachBatch(table.add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress += query.recentProgress
    return {r["token"]: r["visits"] for r in table.rows().collect()}


def test_late_visits_count_until_the_expiry(spark, tmp_path):
    progress: list = []
    rows = [("s", "2024-01-01", 1, "2024-01-20", None), ("s", "2024-01-10", 1, "2024-01-20", None), ("s", "2024-01-05", 1, "2024-01-20", None)]  # the last is five days late
    assert budget(spark, str(tmp_path), rows, str(tmp_path / "c"), progress) == {"s": 3}
    rows = [("t", "2024-01-15", 9, "2024-01-30", 4.0), ("s", "2024-01-21", 5, "2024-01-20", None), ("z", "2024-02-10", 1, None, None), ("s", "2024-01-19", 1, "2024-01-20", None), ("z", "2024-01-02", 2, None, None)]
    # s and t are over when the watermark is at 9 February; z, without expiry, counts whatever is late
    assert budget(spark, str(tmp_path), rows, str(tmp_path / "c"), progress) == {"s": 3, "t": 4, "z": 3}
    assert all(o["numRowsDroppedByWatermark"] == 0 for p in progress for o in p["stateOperators"])
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # only z has state


def test_all_batches_in_one_or_many(spark, tmp_path):
    rows = [(f"k{i % 3}", f"2024-01-{1 + i * 7 % 20:02d}", 1, "2024-03-01" if i % 3 else None, 5.0 if i % 3 == 2 else None) for i in range(20)]
    want = {"k0": 7, "k1": 7, "k2": 5}
    assert budget(spark, str(tmp_path / "many"), rows[:8], str(tmp_path / "c1"), []) and budget(spark, str(tmp_path / "many"), rows[8:], str(tmp_path / "c1"), []) == want


def test_an_empty_stream_is_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], ROW).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
    assert streaming.merged(stream, S.keep_last_n(spark, str(tmp_path / "t"), 2)).count() == 0


def test_progress_is_summed_before_it_is_merged(spark, tmp_path):
    """A row a user and note, whatever the batches; nothing is kept in a state store or goes through Python."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(e, f"u{rng.randrange(3)}", f"n{rng.randrange(3)}", start + timedelta(hours=rng.randrange(4)), rng.randrange(15000) / 100) for e in range(120)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "event_id long, user string, path string, ts timestamp, amount double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = S.progress(spark, str(tmp_path / "t"))
    query = S.progress_rows(stream).writeStream.foreachBatch(table.add).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 4 and not any(p["stateOperators"] for p in query.recentProgress)
    want = {}
    for e, user, path, ts, amount in sorted(rows, key=lambda r: (r[3], r[0])):
        want[user, path] = (min(amount, 100.0), round(want.get((user, path), (0, 0))[1] + amount, 4), amount >= 95)
    assert {(r["user"], r["path"]): (r["percent"], r["duration"], r["completed"]) for r in S.progress_told(table.rows()).collect()} == want
    counts = S.access_counts(spark, str(tmp_path / "n"))
    for epoch, n in ((0, 2), (1, 3), (1, 3)):
        counts.add(spark.createDataFrame([("p", start, n), ("p", start, 1)], "path string, ts timestamp, n long"), epoch)
    assert [r["n"] for r in counts.rows().collect()] == [7]


def test_notes_are_streamed_a_bounded_folder_at_a_time(spark, data, monkeypatch):
    """What the driver lists and keeps at once does not grow with the notes."""
    from marginalia import catalog
    from marginalia.sources.vault import derived_vault

    listed, stream = [], S.stream_notes
    monkeypatch.setattr(streaming, "FILES", 60)
    monkeypatch.setattr(S, "stream_notes", lambda spark, root: listed.append(sum(1 for p in Path(root).rglob("*.md"))) or stream(spark, root))
    told = sorted(map(tuple, catalog.QUERIES["stream_notes"](spark, data).collect()))
    assert told == sorted((r["path"], len(r["raw"])) for r in derived_vault(spark, data).collect())
    assert sum(listed) == len(told) and len(listed) == 4 and max(listed) < 90


def test_a_row_is_merged_as_often_as_the_table_doubles(spark, tmp_path, monkeypatch):
    """Files of one level are folded, not the whole table each time; an earlier mark without levels is read too."""
    table = StateTable(spark, str(tmp_path / "t"), ["user"], newest(["user"], 100, F.desc("event_id")), buckets=1, fan=2)
    put, written = table._put, []
    monkeypatch.setattr(table, "_put", lambda rows, name: (put(rows, name), written.append(spark.read.parquet(f"{table.path}/{name}").count()))[0])
    seen = []
    for epoch, rows in enumerate(batches(9, 10)):
        table.add(spark.createDataFrame(rows, ROW), epoch)
        seen += rows
    assert told(table) == sorted(seen, key=str)
    assert sum(written) - len(seen) <= 10 * (2 + 4 + 2 + 8)  # 10 * (2 + 3 + .. + 9) where all is merged each time
    mark = json.loads(spark.read.parquet(str(tmp_path / "t" / "marks")).orderBy(F.desc("epoch")).first()["mark"])
    mark.pop("level")
    spark.createDataFrame([(json.dumps(mark),)], "mark string").write.mode("overwrite").parquet(f"{table.path}/marks/epoch=8")
    table.add(spark.createDataFrame(rows := batches(10, 10)[9], ROW), 9)
    assert told(table) == sorted(seen + rows, key=str)


def test_texts_are_dealt_to_buckets_in_one_exchange(spark, tmp_path):
    table = S.merge_notes(spark, str(tmp_path / "t"))
    rows = [(f"p{k}", datetime(2024, 1, 1 + k % 3), f"r{k}") for k in range(9)]
    notes = "path string, mtime timestamp, raw string"
    assert table._folded(spark.createDataFrame(rows, notes).withColumn("epoch", F.lit(1).cast("long")), table.fold)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    table.add(spark.createDataFrame(rows, notes), 0)
    table.add(spark.createDataFrame([("p1", datetime(2020, 1, 1), "new"), ("p2", datetime(2024, 1, 1), "a"), ("p2", datetime(2024, 1, 2), "b")], notes), 1)
    assert table.rows().columns == ["path", "mtime", "raw"]
    assert {r["path"]: r["raw"] for r in table.rows().collect()} == {r[0]: r[2] for r in rows} | {"p1": "new", "p2": "b"}
    told = table.rows(lambda rows: rows.select("path", "epoch", F.length("raw").alias("chars")))
    assert {r["path"]: r["chars"] for r in told.collect()} == {f"p{k}": 2 for k in range(9)} | {"p1": 3, "p2": 1}
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("length(raw") > plan.index("Window")  # below it: no text is exchanged


def test_notes_are_listed_by_few_tasks_and_two_folders_at_once(spark, data, monkeypatch):
    """A batch's files are looked up by a few tasks a core, and the driver lists a folder while another is merged."""
    from threading import Lock

    from marginalia import catalog
    from marginalia.sources.vault import derived_vault

    lock, ran, now, most, cached = Lock(), streaming.ran, [], [], []

    def counted(*given):
        with lock:
            now.append(1)
            most.append(len(now))
            cached.append(spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize"))
        try:
            ran(*given)
        finally:
            with lock:
                now.pop()

    monkeypatch.setattr(streaming, "FILES", 60)
    monkeypatch.setattr(streaming, "ran", counted)
    name, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    jobs, was = sc._jsc.sc().dagScheduler().numTotalJobs, spark.conf.get(name)
    before = jobs()
    told = sorted(map(tuple, catalog.QUERIES["stream_notes"](spark, data).collect()))
    assert told == sorted((r["path"], len(r["raw"])) for r in derived_vault(spark, data).collect())
    assert len(most) == 4 and max(most) == 2 and spark.conf.get(name) == was and {*cached} == {"0"}
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in range(before, jobs()) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism
