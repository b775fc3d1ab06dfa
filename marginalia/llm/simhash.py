"""Operator 9: SimHash near-duplicates linked by BK-trees.

A document's fingerprint takes each bit by majority over the XXH64 values of its
three-word shingles. Equal fingerprints become one before any search. Fingerprints
within ``RADIUS`` bits agree on at least two of five blocks of their bits, so each is
dealt to ten shards, one for each pair of blocks and their value, and every link shows
in some shard. A shard of more than ``TREE`` fingerprints is dealt again in the same way by
its other bits. A shard's fingerprints form BK-trees: a node's children are keyed by
their Hamming distance to it, and a search follows only edges within the radius of
the node's distance to what is sought. What is still larger after the second deal (about
2^15 times ``TREE``, or very many variants of one text) is divided into trees of ``TREE``
fingerprints, and all of it is sent to each of them: no task holds more than one tree at a
time, and the others stream by.

Only links that join two groups are returned (a forest of each tree), never all pairs
within a group. Groups are found by alternating large-star and small-star steps with
a checkpoint after each, in plain joins and minima; their nodes are fingerprints.

Null and empty texts have fingerprint zero and link like any other. A null doc_id is
larger than any other; a group of only such has a null component_id. Extra columns are
ignored. ``deduplicate`` tells rows apart by id and text: one row of each group stays, also
of rows that repeat entirely or have no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, written

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Blocks of the bits outside a pair of blocks, 38 or 39 of them.
INNER = ((0, 8), (8, 8), (16, 8), (24, 8), (32, 7))
PAIRS = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
TREE = 4096


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(fps)], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text").mapInArrow(run, "doc_id long, key string, fp long")


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


class BKTree:
    """Fingerprints by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Indexes of the nodes within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            k = stack.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            stack += [child for edge, child in self.children[k].items() if d - radius <= edge <= d + radius]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) > 1:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                if d not in self.children[at]:
                    self.children[at][d] = len(self.values) - 1
                    return
                at = self.children[at][d]


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tree, its own fingerprints first. Links that join groups of a tree."""
    at, tree, nodes, parent = None, BKTree(), [], []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for batch in batches:
        a, b = [], []
        for *key, own, node in zip(*(batch[c].to_pylist() for c in ("shard", "inner", "part", "own", "fp")), strict=True):
            if key != at:
                at, tree, nodes, parent = key, BKTree(), [], []
            fp = node & (1 << 64) - 1
            near = {root(k) for k in tree.search(fp, RADIUS)}
            for k in near:
                a.append(node)
                b.append(nodes[k])
            if own:
                tree.add(fp)
                nodes.append(node)
                parent.append(len(parent))
                for k in near:
                    parent[k] = len(parent) - 1
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block(x: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(x, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def _shards(x: Column, blocks: tuple = BLOCKS) -> Column:
    """A number for each pair of blocks and their values."""
    return F.array(*(F.lit(n << 26).cast("long") + _block(x, blocks[i]) * (1 << 13) + _block(x, blocks[j]) for n, (i, j) in enumerate(PAIRS)))


def _other_bits(fp: Column, shard: Column) -> Column:
    """The bits outside the pair of blocks that the shard is of, side by side."""
    rest = []
    for pair in PAIRS:
        at, bits = 0, F.lit(0).cast("long")
        for k in set(range(len(BLOCKS))) - set(pair):
            bits, at = bits + F.shiftleft(_block(fp, BLOCKS[k]), at), at + BLOCKS[k][1]
        rest.append(bits)
    return F.get(F.array(*rest), F.shiftright(shard, 26).cast("int"))


def _counted(dealt: DataFrame) -> DataFrame:
    """Rows of shards that hold two fingerprints or more, with their number."""
    sizes = dealt.groupBy("shard", "inner").agg(F.count("*").alias("n")).where("n > 1")
    return dealt.join(sizes, ["shard", "inner"])


def links(fps: DataFrame, tree: int = TREE) -> DataFrame:
    """(a, b): a forest that joins all fingerprints within the radius; ``fps`` has each once."""
    first = _counted(fps.select("fp", F.explode(_shards(F.col("fp"))).alias("shard"), F.lit(-1).cast("long").alias("inner")))
    # the other bits are a column of their own: written out in each shard's number they make a method of more than 64 KB
    rest = first.where(F.col("n") > tree).select("fp", "shard", _other_bits(F.col("fp"), F.col("shard")).alias("rest"))
    again = _counted(rest.select("fp", "shard", F.explode(_shards(F.col("rest"), INNER)).alias("inner")))
    parts = F.ceil(F.col("n") / F.lit(tree)).cast("int")
    rows = first.where(F.col("n") <= tree).unionByName(again).withColumn("home", F.pmod(F.xxhash64("fp"), parts).cast("int")).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = rows.select("shard", "inner", "part", (F.col("home") == F.col("part")).alias("own"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "shard", "inner", "part").sortWithinPartitions("shard", "inner", "part", F.desc("own"))
    return ordered.mapInArrow(_tree_links, "a long, b long")


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node in ``pairs``: the smallest node it is joined to."""
    edges = durable(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        after = sign(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"groups are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def grouped(told: DataFrame) -> DataFrame:
    """fp and root, the smallest fingerprint that it is joined to, for each fingerprint in ``told``."""
    fps = durable(told.select("fp").distinct())
    groups = components(links(fps)).withColumnRenamed("node", "fp")
    return durable(fps.join(groups, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every document."""
    told = durable(fingerprints(docs).drop("key"))
    roots = grouped(told)
    classes = told.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp")
    ids = durable(classes.groupBy("root").agg(F.min("first").alias("component_id")))
    settled = durable(roots.join(ids, "root").select("fp", "component_id"))
    return told.join(settled, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest doc_id, of equal ones that with the smallest key.
    Of rows that are equal in doc_id and text and differ in other columns, any one stays."""
    told = durable(fingerprints(docs))
    rows = told.groupBy("doc_id", "key").agg(F.min("fp").alias("fp"), F.count("*").alias("n"))  # equal texts have equal fingerprints
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")
    first = rows.join(grouped(told), "fp").groupBy("root").agg(F.min(order).alias("r"))
    stays = written(first.select(F.col("r.doc_id").alias("id"), "r.key", "r.n"))

    def chosen(these: DataFrame) -> DataFrame:
        return docs.join(these, [docs["doc_id"].cast("long").eqNullSafe(these["id"]), _key(docs["text"]) == these["key"]], "left_semi")

    repeated = stays.where("n > 1")
    if repeated.isEmpty():
        return chosen(stays)
    return chosen(stays.where("n = 1")).unionByName(chosen(repeated).dropDuplicates(["doc_id", "text"]))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = near_duplicates(table(spark, sf_dir, "documents"))
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
