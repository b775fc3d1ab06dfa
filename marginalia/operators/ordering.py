"""A global order without one task for all rows.

Rows are dealt by range and sorted within their range; what crosses ranges is a row of
each range: its count, its first and its last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Names of the range and of the place within it.
RANGE, PLACE = "__range", "__place"


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with the number of their range and, from 0, their place within it: both grow
    with the order. They are checkpointed, as a range that is computed again need not be cut
    at the same rows. Rows that are equal in ``order`` share a range: name a last column
    that tells them apart where they may be very many."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = settled(dealt)
    return kept.withColumn(RANGE, F.shiftright("__at", 33).cast("int")).withColumn(PLACE, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def numbered(rows: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """The rows with ``name``, 1 2 3... in the order, gapless."""
    kept = ranged(rows, *order)
    counts = kept.groupBy(RANGE).agg(F.count("*").alias("__rows"))
    before = counts.select(RANGE, (F.sum("__rows").over(Window.orderBy(RANGE)) - F.col("__rows")).alias("__before"))  # a row a range
    return kept.join(F.broadcast(before), RANGE).withColumn(name, F.col("__before") + F.col(PLACE) + 1).drop(RANGE, PLACE, "__before")


def neighbours(rows: DataFrame, column: str, *order: Column) -> DataFrame:
    """The rows with ``previous`` and ``next``: the values of ``column`` in the rows before and
    after. A range looks within itself; its ends look at the ends of the ranges beside it."""
    kept = ranged(rows, *order)
    within = Window.partitionBy(RANGE).orderBy(PLACE)
    ends = kept.groupBy(RANGE).agg(F.min_by(column, PLACE).alias("first"), F.max_by(column, PLACE).alias("last"))
    across = Window.orderBy(RANGE)  # a row a range
    ends = ends.select(RANGE, F.lag("last").over(across).alias("__before"), F.lead("first").over(across).alias("__after"))
    told = kept.withColumns({"previous": F.lag(column).over(within), "next": F.lead(column).over(within)}).join(F.broadcast(ends), RANGE)
    return told.withColumns({"previous": F.coalesce("previous", "__before"), "next": F.coalesce("next", "__after")}).drop(RANGE, PLACE, "__before", "__after")
