"""Operator 8: range sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records fall into the
ranges between them; ranges that turn out overfull are sampled again and divided.
Exact byte and row counts per range then place every record on a line of bytes
that is cut into shards of equal length, so a shard boundary may lie inside a range.

The key is (md5 of the text, doc_id): equal texts stand next to each other. A group of them
shares a shard unless a boundary falls inside it; then its records up to the boundary, in the
order of doc_id, are in one shard and the rest in the next, so a group that holds a third of
all rows takes a third of the shards. That is the law: bytes are near equal whatever the groups.

There is a range for every ``RANGE_BYTES`` of text, ``ranges_per_shard`` for each shard at
least and ``MAX_RANGES`` in all at most: a window holds one range, of records without their
texts, and spills. A range that holds over twice its share is sampled again, more densely each time, and
divided, until no range is overfull but those of one key (equal text and doc_id). Splitters decide where
the work is done; the exact counts of the ranges decide what it gives, so that shards are even to a
record and not only as even as a sample.

Null or empty text counts as one byte. Null doc_ids sort first. Rows that repeat
entirely are all kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

RANGE_BYTES, MAX_RANGES = 64 << 20, 4096
#: Splitters that are looked at one by one.
STRIDE = 64
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _range_of(splitters: list[tuple[str, int | None]], key: Column) -> Column:
    """How many splitters are at or below the key."""
    if not splitters:
        return F.lit(0)
    bounds = lambda these: F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).cast("long").alias("i")) for k, i in these))
    below = lambda these: F.size(F.filter(these, lambda s: s <= key))
    if len(splitters) <= STRIDE:
        return below(bounds(splitters))
    coarse = below(bounds(splitters[STRIDE::STRIDE])) * STRIDE
    return coarse + below(F.slice(bounds(splitters), coarse + 1, F.lit(STRIDE)))


def _place(key: tuple) -> tuple:
    """The order of keys: null doc_ids first."""
    return key[0], key[1] is not None, key[1] or 0


def _sample(records: DataFrame, rate: float, seed: int) -> list[tuple[str, int | None]]:
    """Keys drawn with chance size * rate, in order; its expected number is fixed by the caller."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11).cast("double") / F.lit(float(1 << 53))
    rows = records.where(u < F.col("size") * F.lit(rate)).select("key", "doc_id").distinct().collect()
    return sorted(((r["key"], r["doc_id"]) for r in rows), key=_place)


def shard_by_bytes(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 12, samples_per_range: int = 24) -> DataFrame:
    """One row per document: its shard of near equal bytes and its gapless slot there.

    What reaches the driver is bounded by parameters: ``samples_per_range`` expected sample
    keys and one row of counts for each range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("key"),
        )
    )
    total, n = records.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    wanted = min(max(shards * ranges_per_shard, -(-total // RANGE_BYTES)), max(MAX_RANGES, shards * ranges_per_shard))
    drawn = _sample(records, wanted * samples_per_range / total, 0)
    splitters = sorted(set(drawn[samples_per_range::samples_per_range]), key=_place)
    key = F.struct(F.col("key").alias("k"), F.col("doc_id").alias("i"))
    limit = 2 * total / wanted
    again = 0
    while True:
        placed = records.withColumn("range", _range_of(splitters, key))
        each = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("most"))
        counts = {r["range"]: r for r in each.collect()}  # a row a range
        over = [r for r in counts.values() if r["bytes"] > limit and r["least"] != r["most"]]
        if not over:
            break
        again += 1
        more = _sample(placed.where(F.col("range").isin([r["range"] for r in over])), wanted * samples_per_range * again / total, again)
        for r in over:  # its sampled keys but the least, some apart; or the greatest, so that every division divides
            inner = [x for x in more if _place(r["least"]) < _place(x) <= _place(r["most"])]
            splitters = splitters + (inner[samples_per_range::samples_per_range] or inner[len(inner) // 2 :][:1] or [tuple(r["most"])])
        splitters = sorted(set(splitters), key=_place)

    line, before, rank = [], 0, 0
    for r in sorted(counts):
        line.append((r, before, rank))
        before, rank = before + counts[r]["bytes"], rank + counts[r]["rows"]
    starts = spark.createDataFrame(line, "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("key", "doc_id")
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    cut = durable(
        placed.join(F.broadcast(starts), "range")  # one row per range: bounded by the parameters
        .withColumn("shard", F.floor(middle * shards / (2 * F.lit(total))).cast("int"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
    )
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def oracle(shards: int = 16) -> str:
    """The same rows by one window over everything; CRC-32 by its byte table, made by rule."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    octets = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)"
    return f"""
    with crc as (select {table}::bigint[] as t),
    d as (select doc_id, strlen(coalesce(text, '')) + 1 as size, md5(coalesce(text, '')) as key,
      xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::bigint) as text_crc32 from documents, crc),
    s as (select *, ((2 * sum(size) over (order by key, doc_id) - size) * {shards} // (2 * sum(size) over ()))::int as shard from d)
    select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by key, doc_id) - 1 as slot, null::int as grown_shard from s
    """
