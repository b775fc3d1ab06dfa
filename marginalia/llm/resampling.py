"""Operator 11: importance resampling towards a target distribution.

Words and their runs of up to ``longest`` are hashed into ``buckets``. What a bucket's share
is worth in the target against the raw documents is its gain, an array of so many integers;
a document's weight is the floored mean of the gains of its features, looked up in that
array. The weight and a Gumbel number made from the doc_id give the score, and the ``percent``
of the documents of ``min_words`` words or more that score highest are drawn: a sample without
replacement by importance.

The cutoff is found by a quantile sketch: two of its quantiles bracket the place of the last
document drawn; exact counts outside the bracket tell whether it is inside, and the bracket
is widened until it is. Only the bracket is sorted then, by range, to read the cutoff off.
Drawn documents are ranked by range as well, so no task sees all of them.

The text is read twice, once for the counts of the buckets and once for the scores; scores
are checkpointed. To the driver come a row a bucket, two quantiles and counts.

Null or empty text has no features, weight 0 and is never drawn; a null doc_id is hashed as
empty and ranks first among equal scores. Repeated rows are scored alike and drawn one by
one. Extra columns are ignored. Empty documents give an empty result; an empty target gives
every bucket the same share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import PLACE, RANGE, numbered, ranged
from .common import NON_WORD, durable, only_a_z_lower, split_words, table

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: One over the rank error of the sketch, relative to the number of rows.
ACCURACY = 1000


def words_of(text: Column) -> Column:
    return split_words(only_a_z_lower(text), NON_WORD)


def runs(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space. ``words`` must be a
    plain column."""
    long = lambda k: F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(k - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(words[i + j] for j in range(1, k))))
    return F.concat(words, *(long(k) for k in range(2, longest + 1))) if longest > 1 else words


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> list[int]:
    """How many features of all texts lie in each bucket."""
    features = docs.select(words_of(F.col("text")).alias("w")).select(F.explode(runs(F.col("w"), longest)).alias("feature"))
    told = dict(tuple(r) for r in features.groupBy(bucket(F.col("feature"), buckets).alias("b")).count().collect())  # a row a bucket
    return [told.get(b, 0) for b in range(buckets)]


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of the smoothed share in the target over that in the raw documents."""
    n, s, t = len(raw), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw, target, strict=True)]


def weighed(docs: DataFrame, gain: list[int], longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    worth = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # one literal
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    df = df.select("doc_id", F.size("w").cast("long").alias("n_words"), runs(F.col("w"), longest).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda s, f: s + F.get(worth, bucket(f, len(gain))))
    df = df.select("doc_id", "n_words", F.size("f").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return df.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).cast("long").alias("score"))


def bracket(rows: DataFrame, wanted: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Scores lo and hi so that the row at place ``wanted`` from the highest of ``n`` scores lies
    between them, both included, and the exact number of rows above hi."""
    slack = 1 / accuracy
    while True:
        at = 1 - wanted / n
        lo, hi = rows.agg(F.percentile_approx("score", [max(at - slack, 0.0), min(at + slack, 1.0)], accuracy)).first()[0]
        above, below = rows.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score") < lo)).first()
        if above < wanted <= n - below:
            return lo, hi, above
        if slack >= 1:  # quantiles 0 and 1 of a coarse sketch
            lo, hi = rows.agg(F.min("score"), F.max("score")).first()
            return lo, hi, 0
        slack *= 4


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """doc_id, n_features, weight, score and rank, null where a document is not drawn."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    # the row number tells rows of one score and doc_id apart, so that none of their ranges is large
    rows = durable(weighed(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()))
    fit = rows.where(F.col("n_words") >= min_words)
    n = fit.count()
    wanted = n * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    order = (F.desc("score"), F.asc("doc_id"), F.asc("row"))
    lo, hi, above = bracket(fit, wanted, n, accuracy)
    inside = ranged(fit.where(F.col("score").between(lo, hi)), *order)
    left = wanted - above  # the cutoff is so far down the bracket
    for at, size in sorted(tuple(r) for r in inside.groupBy(RANGE).count().collect()):  # a row a range
        if left <= size:
            break
        left -= size
    last = inside.where((F.col(RANGE) == at) & (F.col(PLACE) == left - 1)).first()
    key = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("row").alias("r"))
    cut = F.struct(F.lit(-last["score"]).cast("long").alias("s"), F.lit(last["doc_id"] is not None).alias("given"), F.lit(last["doc_id"] or 0).cast("long").alias("d"), F.lit(last["row"]).cast("long").alias("r"))
    drawn = (F.col("n_words") >= min_words) & (key <= cut)
    ranked = numbered(rows.where(drawn), *order, name="rank").select(*shown, F.col("rank").cast("long").alias("rank"))
    return ranked.unionByName(rows.where(~drawn).select(*shown, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same rows by one window over everything; CRC-32 by its byte table, made by rule."""
    crc = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    octets = "list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::bigint)"
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with crc as (select {crc}::bigint[] as t),
    d as (select doc_id, {words} as ws from documents), g as (select {words} as ws from benchmark),
    vocabulary as (select w, xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::bigint) % {BUCKETS} as b
      from (select distinct w from (select unnest(ws) as w from d union all select unnest(ws) from g)), crc),
    raw as (select b, count(*) as s from (select unnest(ws) as w from d) join vocabulary using (w) group by b),
    target as (select b, count(*) as t from (select unnest(ws) as w from g) join vocabulary using (w) group by b),
    gains as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from raw) + {BUCKETS})::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from target) + {BUCKETS})::double)))::bigint as gain
      from (select distinct b from vocabulary) left join raw using (b) left join target using (b)),
    weights as (select doc_id, sum(gain) as total, count(*) as n from (select doc_id, unnest(ws) as w from d) join vocabulary using (w) join gains using (b) group by doc_id),
    scored as (select doc_id, len(ws)::bigint as n_features, coalesce(floor(total / n)::bigint, 0) as weight,
      coalesce(floor(total / n)::bigint, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score from d left join weights using (doc_id)),
    ranked as (select *, row_number() over (partition by n_features >= {MIN_WORDS} order by score desc, doc_id) as place, count(*) over (partition by n_features >= {MIN_WORDS}) as n from scored)
    select doc_id, n_features, weight, score, case when n_features >= {MIN_WORDS} and place <= n * {PERCENT} // 100 then place end as rank from ranked
    """
