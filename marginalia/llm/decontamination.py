"""Operator 3: benchmark decontamination by size-partitioned MinHash containment.

An item is contained in a document if the document holds at least ``CONTAINMENT`` of
the item's distinct shingles of five words, however long the document is; the only
shingle of an item of fewer words is all of them, and documents are cut into shingles
of that length too. Items are partitioned by their number of shingles. The MinHash
sketch of an item is its ``k`` smallest shingle hashes, where ``k`` is set by its
partition so that ``k > n - CONTAINMENT * n`` for every size ``n`` in it: a document that
contains the item must hold at least one value of the sketch, so no contained item is
missed.

1. Candidates. Hashes of a document's shingles meet the sketches alone.
2. Verification. For those pairs, and in those documents alone, all of the item's
   shingles are counted, as words and not as hashes.

The tables of items grow with the benchmark, not with the documents. They are broadcast up
to ``BROADCAST_ROWS`` rows; beyond, hashes are shuffled, and adaptive execution splits a
shingle that very many documents hold. The keys of candidate and of contaminated texts are
counted and broadcast up to ``BROADCAST_KEYS`` rows; beyond, texts are shuffled once by key.

Words are lower-cased runs of digits, letters and characters beyond ASCII; what has none
contains nothing and is contained nowhere. Null texts count as empty; extra columns are
ignored. Rows are told apart by id and text: rows that share an id, or have none, are judged
each by its own text, and rows that repeat entirely are told once. Containment depends on
the text alone, so ``decontaminate`` drops by text, whatever the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, split_words, table, word_hashes, written

WORDS = 5
CONTAINMENT = 0.8
BROADCAST_ROWS = 1_000_000
BROADCAST_KEYS = 300_000


def _words(text: str) -> Column:
    return split_words(F.lower(F.coalesce(F.col(text), F.lit(""))), NON_WORD)


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _spelled(w: Column, size: int) -> Column:
    """Every run of ``size`` words: its hash and its words."""
    return F.transform(word_hashes(w, size), lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("g")))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, item_key, size (words of a shingle), h, g: the distinct shingles of each item."""
    words = items.select("item_id", _key("text").alias("item_key"), _words("text").alias("w")).where(F.size("w") > 0)
    short = F.when(F.size("w") == 1, _spelled(F.col("w"), 1))
    for n in range(2, WORDS):
        short = short.when(F.size("w") == n, _spelled(F.col("w"), n))
    held = words.select("item_id", "item_key", F.least(F.size("w"), F.lit(WORDS)).alias("size"), F.explode(short.otherwise(_spelled(F.col("w"), WORDS))).alias("s"))
    return held.select("item_id", "item_key", "size", "s.h", "s.g").distinct()


def sketches(held: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The shingles with n_item and whether each is in its item's MinHash sketch."""
    # sizes in (2^(p-1), 2^p] form partition p; its sketch suits its largest size
    sizes = held.groupBy("item_id", "item_key", "size").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list(F.struct("h", "g"))).alias("all"))  # an item is short
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item"))).cast("int")
    k = upper - F.ceil(upper * F.lit(containment) - F.lit(1e-9)).cast("int") + 1
    told = sizes.withColumn("k", F.least(k, F.col("n_item")).cast("int"))
    return told.select("item_id", "item_key", "size", "n_item", F.posexplode("all").alias("place", "s"), "k").select("item_id", "item_key", "size", "n_item", "s.h", "s.g", (F.col("place") < F.col("k")).alias("sketch"))


def candidates(docs: DataFrame, lookup: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """doc_id, key, item_id, item_key of the pairs that meet in a sketch."""
    words = docs.select("doc_id", _key("text").alias("key"), _words("text").alias("w"))
    hashes = words.select("doc_id", "key", F.explode(F.concat(*(word_hashes(F.col("w"), n) for n in sizes))).alias("h"))
    sketched = lookup.where("sketch").select("item_id", "item_key", "h")
    return hashes.join(F.broadcast(sketched) if small else sketched, "h").select("doc_id", "key", "item_id", "item_key").distinct()


def _sent(keys: DataFrame) -> DataFrame:
    """Written keys, broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, key (of the text), item_id, n_shared and n_item shingles, containment: the verified pairs."""
    lookup = written(sketches(item_shingles(items), containment))
    sizes = sorted(r["size"] for r in lookup.select("size").distinct().collect()) or [WORDS]  # at most WORDS
    small = lookup.count() <= BROADCAST_ROWS
    pairs = written(candidates(docs, lookup, sizes, small))
    words = docs.withColumn("key", _key("text")).join(_sent(pairs.select("key").distinct()), "key", "left_semi").select("doc_id", "key", _words("text").alias("w"))
    spelled = words.select("doc_id", "key", F.explode(F.concat(*(_spelled(F.col("w"), n) for n in sizes))).alias("s")).select("doc_id", "key", "s.h", "s.g")
    wanted = lookup.drop("sketch", "size")
    met = spelled.join(F.broadcast(wanted) if small else wanted, ["h", "g"]).select("doc_id", "key", "item_id", "item_key", "n_item", "g").distinct()
    counted = met.groupBy("doc_id", "key", "item_id", "item_key", "n_item").agg(F.count("*").alias("n_shared"))
    same = F.expr("c.key = p.key and c.item_key = p.item_key and c.doc_id <=> p.doc_id and c.item_id <=> p.item_id")
    told = counted.alias("c").join(pairs.alias("p"), same, "left_semi")
    enough = F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(containment) - F.lit(1e-9))
    return told.where(enough).select("doc_id", "key", "item_id", "n_shared", "n_item", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item."""
    found = written(contained_items(docs.select("doc_id", "text"), items, containment).select("key").distinct())
    return docs.join(_sent(found), _key("text") == found["key"], "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def oracle() -> str:
    words = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with dw as (select distinct doc_id, md5(coalesce(text, '')) as key, {words} as w from documents), bw as (select distinct item_id, md5(coalesce(text, '')) as item_key, {words} as w from benchmark),
    sizes as (select distinct least(len(w), {WORDS}) as m from bw where len(w) > 0),
    d as (select distinct doc_id, key, m, array_to_string(w[i : i + m - 1], ' ') as g from (select *, unnest(generate_series(1, len(w) - m + 1)) as i from dw, sizes)),
    b as (select distinct item_id, item_key, m, array_to_string(w[i : i + m - 1], ' ') as g from (select *, unnest(generate_series(1, len(w) - m + 1)) as i from (select *, least(len(w), {WORDS}) as m from bw where len(w) > 0))),
    n as (select item_id, item_key, count(*) as n_item from b group by all), s as (select doc_id, key, item_id, item_key, count(*) as n_shared from d join b using (m, g) group by all)
    select doc_id, s.item_id, n_shared, n_item, round(n_shared / n_item, 6) as containment from s join n on s.item_key = n.item_key and s.item_id is not distinct from n.item_id where n_shared >= ceil(n_item * {CONTAINMENT} - 1e-9)
    """
