"""Tables that streams merge their batches into, in hash buckets of their key.

A batch adds its rows to the buckets it touches as new files, so what it writes follows the batch
and not the table; whoever reads folds the files of a bucket. ``fan`` files of a bucket and level are folded
into one of the next level, so no row is written more often than the logarithm of the table asks. A mark for each
batch names the files of each bucket; a batch that runs again starts from the mark before and
writes the same, and files that a mark no longer names go one batch later.

``fold`` takes rows with ``epoch``, the number of their batch, and gives rows of the same columns: those that
still count. It must be free to be applied to any part of a key's rows first, as the greatest n or the
last one by key are.

A table that is ``dealt`` sends rows to their buckets before they are folded, in one exchange: for folds that leave most rows
and group by ``bucket`` first. Otherwise they are folded first, and what is left is sent. ``refold`` folds rows that were folded
in their batch, where that needs fewer columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove


class StateTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], buckets: int = 64, fan: int = 8, dealt: bool = False, refold: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.keys, self.fold, self.buckets, self.fan, self.dealt = spark, path.rstrip("/"), keys, fold, buckets, fan, dealt
        self.refold = refold or fold

    def _mark(self, before: int | None = None) -> dict:
        """The last mark, or the last of the batches before one."""
        try:
            marks = self.spark.read.schema("mark string, epoch long").parquet(f"{self.path}/marks")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {"files": {}, "gone": [], "schema": None}
        marks = marks.where(F.col("epoch") < before) if before is not None else marks
        last = marks.agg(F.max_by("mark", "epoch")).first()[0]
        return json.loads(last) if last else {"files": {}, "gone": [], "schema": None}

    def _put(self, rows: DataFrame, name: str) -> list[int]:
        """Writes rows into a folder a bucket; the buckets that got some."""
        at = f"{self.path}/{name}"
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at)
        return [r[0] for r in self.spark.read.schema("bucket int").parquet(at).distinct().collect()]  # a row a folder

    def _read(self, schema: str, files: list[str], base: str = "") -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _folded(self, rows: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What still counts of the rows, a task a bucket at most."""
        return fold(self._bucketed(rows).repartition("bucket")) if self.dealt else self._bucketed(fold(rows)).repartition("bucket")

    def _due(self, files: list[str], level: dict[str, int]) -> tuple[list[str], int]:
        """The files of a bucket that are to be folded into one, and its level: those of the lowest level if it has
        ``fan``, and of each level above that is full with the new one."""
        due, at = [], 0
        while (own := [f for f in files if level.get(f, 0) == at]) and len(own) + bool(due) >= self.fan:
            due, at = [*due, *own], at + 1
        return due, at

    def add(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``. The batch is computed once: what is merged on is read back."""
        mark = self._mark(before=epoch)
        rows = self._folded(batch.withColumn("epoch", F.lit(epoch).cast("long")), self.fold)
        files, gone, schema = dict(mark["files"]), [], ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "bucket")
        for b in self._put(rows, f"batch-{epoch}"):
            files[str(b)] = [*files.get(str(b), []), f"batch-{epoch}/bucket={b}"]
        level = mark.get("level", {})
        full = {b: (due, at) for b, fs in files.items() for due, at in [self._due(fs, level)] if due}
        if full:
            gone = [f for due, _ in full.values() for f in due]
            there = {*map(str, self._put(self._folded(self._read(schema, gone), self.refold), f"merged-{epoch}"))}
            merged = {b: f"merged-{epoch}/bucket={b}" for b in full if b in there}
            files |= {b: [f for f in files[b] if f not in due] + [merged[b]] * (b in merged) for b, (due, _) in full.items()}
            level = level | {f: full[b][1] for b, f in merged.items()}
        live = {f for fs in files.values() for f in fs}
        told = json.dumps({"files": files, "level": {f: n for f, n in level.items() if f in live}, "gone": gone, "schema": schema})
        self.spark.createDataFrame([(told,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/epoch={epoch}")
        remove(self.spark, *(f"{self.path}/{f}" for f in mark["gone"]))

    def rows(self, told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
        """The table as the last batch left it; None before the first. ``told`` puts other columns in place of those that
        ``refold`` does not need, before rows are exchanged."""
        mark = self._mark()
        if mark["schema"] is None:
            return None
        files = [f for fs in mark["files"].values() for f in fs]
        rows = self._read(mark["schema"], files) if files else self.spark.createDataFrame([], mark["schema"])
        rows = told(rows) if told else rows
        return self.refold(self._bucketed(rows) if self.dealt else rows).drop("epoch", "bucket")


def newest(keys: list[str], n: int, *order) -> Callable[[DataFrame], DataFrame]:
    """Each key's first n rows in an order."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return lambda rows: rows.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= n).drop("__n")


def last(keys: list[str], *order: str) -> Callable[[DataFrame], DataFrame]:
    """Each key's row of the last batch, the greatest by ``order`` within it."""
    return newest(keys, 1, F.desc("epoch"), *map(F.desc, order))
