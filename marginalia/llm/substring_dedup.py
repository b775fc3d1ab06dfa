"""Operator 5: exact removal of byte strings that repeat, by sampled suffix tuples.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is
removed. A full external suffix array would carry a tuple for each byte of the corpus
through every level of its sort; the README gives the figures for why that is not
done. As in induced sorting, only a sample of suffixes is sorted, and the rest is
induced from it:

1. Sampling. The sampled suffix of a string of ``LENGTH`` bytes starts at the
   smallest hash in its first ``SPREAD`` positions: a local minimum, about one for
   each ``SPREAD / 2`` bytes. Equal strings sample the same suffix at the same offset.
   A tuple holds the suffix's place, a name for the ``LENGTH - SPREAD + 1`` bytes that
   all strings of the sample share with it (its common prefix), and a 96-bit name
   for the whole stretch of strings that sample it.
2. Grouping. Spark's disk-backed sort and shuffle bring equal names together, after
   partial aggregation: a stretch that occurs twice is removed wherever it stands.
3. Induction. Of stretches that share a common prefix but differ as a whole (the rims
   of repeats), one representative each is compared string by string, by hashed
   names. Groups that would take more than ``GROUP`` bytes are compared by a shuffle
   of the string names instead of in one task.

Matches never cross documents. Null text counts as empty. Rows that share doc_id and
text are told alike, and repeat each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LENGTH, SPREAD = 400, 256
#: Window starts that are sampled at once; bits that hold a place among them.
SEGMENT, PLACE_BITS = 1 << 20, 22
#: Bytes of memory that one group may take in a task: its stretches and their strings' names.
GROUP, STRING_COST = 64 << 20, 100


def _signed(x: int, bits: int = 64) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _names(b: bytes) -> tuple[int, int]:
    """96 bits that name a byte string: a long and an int."""
    x = xxhash.xxh3_128_intdigest(b)
    return _signed(x >> 64), _signed(x >> 32 & 0xFFFFFFFF, 32)


def _text_hash(b: bytes) -> int:
    return _signed(xxhash.xxh32_intdigest(b), 32)


def sampled(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts lo..hi of the strings that sample each suffix, and the suffix's place."""
    x = np.frombuffer(b, np.uint8).astype(np.uint64)
    for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0xD6E8FEB86659FD93), (8, 0xFF51AFD7ED558CCD)):
        x = x[:-step] * np.uint64(odd) + x[step:]
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << PLACE_BITS) - 1)
    x = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < SPREAD:
        x = np.minimum(x[: len(x) - (SPREAD - width)], x[SPREAD - width :])
    place = (x[: len(b) - LENGTH + 1] & low).astype(np.int64)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    hi = np.concatenate([lo[1:] - 1, [len(place) - 1]])
    return lo, hi, place[lo]


#: Columns of a tuple: its document, the hash of its text, the first string's start and how
#: many more there are, the name of the common prefix and that of the whole stretch.
TUPLE = {"doc_id": pa.int64(), "th": pa.int32(), "lo": pa.int32(), "more": pa.int32(), "key": pa.int64(), "u1": pa.int64(), "u2": pa.int32()}


def suffix_tuples(docs: DataFrame) -> DataFrame:
    """A row of TUPLE for every sampled suffix."""

    def told(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TUPLE.values(), strict=True)], list(TUPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in TUPLE]
            docs, ths, los, mores, keys, u1s, u2s = out
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                b = (text.as_py() or "").encode()
                th = _text_hash(b)
                for s in range(0, len(b) - LENGTH + 1, SEGMENT):
                    part = b[s : s + SEGMENT + LENGTH - 1]
                    lo, hi, at = sampled(part)
                    docs += [doc] * len(lo)
                    ths += [th] * len(lo)
                    los += (lo + s).tolist()
                    mores += (hi - lo).tolist()
                    keys += [_signed(xxhash.xxh3_64_intdigest(part[a : a + LENGTH - SPREAD + 1])) for a in at.tolist()]
                    names = [_names(part[p : q + LENGTH]) for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
                    u1s += [x for x, _ in names]
                    u2s += [x for _, x in names]
                if len(docs) > 50_000:
                    yield told(out)
                    for column in out:
                        column.clear()
            yield told(out)

    return docs.mapInArrow(run, "doc_id long, th int, lo int, more int, key long, u1 long, u2 int")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, th and the compressed text, as it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            th = [_text_hash(b) for b in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(th, pa.int32()), pa.array([squeeze.compress(b) for b in texts], pa.binary())], ["doc_id", "th", "z"])

    return docs.mapInArrow(run, "doc_id long, th int, z binary")


def _same(left: DataFrame, right: DataFrame) -> list:
    return [left["doc_id"].eqNullSafe(right["doc_id"]), left["th"] == right["th"]]


SPAN = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _repeated(group: list[tuple]) -> Iterator[tuple[int | None, int, int, int]]:
    """Of stretches (times, doc_id, th, lo, bytes): the strings of single ones that another has too, as spans."""
    seen: dict[bytes, int] = {}
    for _, _, _, _, b in group:
        for p in range(len(b) - LENGTH + 1):
            d = xxhash.xxh3_128_digest(b[p : p + LENGTH])
            seen[d] = seen.get(d, 0) + 1
    for times, doc, th, lo, b in group:
        if times == 1:
            start = None
            for p in range(len(b) - LENGTH + 2):
                hit = p <= len(b) - LENGTH and seen[xxhash.xxh3_128_digest(b[p : p + LENGTH])] > 1
                if hit and start is None:
                    start = p
                if not hit and start is not None:
                    yield doc, th, lo + start, lo + p - 1 + LENGTH
                    start = None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key; each key's stretches are compared in memory, GROUP bytes at most."""
    key, group, out = None, [], []
    names = ["doc_id", "th", "lo", "end"]

    def told() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        rows = [pa.array(c, t) for c, t in zip(columns, SPAN, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names)

    for batch in batches:
        for k, *row in zip(*(batch[c].to_pylist() for c in ("key", "times", "doc_id", "th", "lo", "b")), strict=True):
            if k != key:
                out += _repeated(group)
                key, group = k, []
            group.append(tuple(row))
        yield told()
    out += _repeated(group)
    yield told()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of every string of a stretch."""
    names = ["doc_id", "th", "lo", "times", "u1", "u2"]
    for batch in batches:
        for times, doc, th, lo, b in zip(*(batch[c].to_pylist() for c in ("times", "doc_id", "th", "lo", "b")), strict=True):
            rows = [(doc, th, lo + p, times, *_names(b[p : p + LENGTH])) for p in range(len(b) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*SPAN, pa.int64(), pa.int32()], strict=True)], names)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each representative's stretch, from its document."""
    expand = zstandard.ZstdDecompressor()
    names = ["key", "mem", "times", "doc_id", "th", "lo", "b"]
    for batch in batches:
        for doc, th, z, wanted in zip(*(batch[c].to_pylist() for c in ("doc_id", "th", "z", "wanted")), strict=True):
            b = expand.decompress(z)
            cols = [[w["key"] for w in wanted], [w["mem"] for w in wanted], [w["times"] for w in wanted], [doc] * len(wanted), [th] * len(wanted), [w["lo"] for w in wanted]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            cut = [b[w["lo"] : w["lo"] + w["more"] + LENGTH] for w in wanted]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(cut, pa.binary())], names)


def repeated_spans(docs: DataFrame, text: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, th, lo, end: spans of bytes to remove; they may overlap. ``text`` is packed(docs)."""
    tuples = written(suffix_tuples(docs))
    stretch = tuples.groupBy("key", "u1", "u2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "lo", "more")).alias("at"))
    keys = stretch.groupBy("key").agg(F.sum("times").alias("n"), F.count("*").alias("d"), F.min("times").alias("least"), F.sum(STRING_COST * (F.col("at.more") + 1) + LENGTH).alias("mem")).where("n > 1")
    met = written(stretch.join(keys, "key").select("key", "u1", "u2", F.least("times", F.lit(2)).cast("int").alias("times"), "at", "d", "least", "mem"))
    whole = tuples.join(met.where("times > 1").select("u1", "u2"), ["u1", "u2"], "left_semi").select("doc_id", "th", "lo", (F.col("lo") + F.col("more") + LENGTH).alias("end"))

    # rims: keys whose stretches are not all repeated as they are
    rims = met.where("d > 1 and least = 1").select("key", "mem", "times", "at.*")
    wanted = rims.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "mem", "times", "lo", "more")).alias("wanted"))  # at most one a sampled suffix of the document
    joined = text.join(wanted, _same(text, wanted)).select(text["doc_id"], text["th"], "z", "wanted")
    cut = joined.mapInArrow(_stretches, "key long, mem long, times int, doc_id long, th int, lo int, b binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lambda df: df.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare, "doc_id long, th int, lo int, end int")
    if rims.where(F.col("mem") > group).isEmpty():
        return whole.unionByName(ordered(cut))
    cut = written(cut)
    strings = cut.where(F.col("mem") > group).mapInArrow(_strings, "doc_id long, th int, lo int, times int, u1 long, u2 int")
    twice = strings.groupBy("u1", "u2").agg(F.count("*").alias("n")).where("n > 1")
    large = strings.where("times = 1").join(twice, ["u1", "u2"], "left_semi").select("doc_id", "th", "lo", (F.col("lo") + LENGTH).alias("end"))
    return whole.unionByName(ordered(cut.where(F.col("mem") <= group))).unionByName(large)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for lo, end in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


#: Bytes of remaining text in a batch that a task gives out.
BATCH = 8 << 20
RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text": pa.string()}


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    rows: list[tuple] = []
    held = 0

    def told() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(RESULT)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RESULT.values(), strict=True)], list(RESULT))

    for batch in batches:
        for doc, z, spans in zip(batch["doc_id"], batch["z"], batch["spans"], strict=True):
            b = expand.decompress(z.as_py())
            runs = merged([(s["lo"], s["end"]) for s in spans.as_py() or []])
            kept, at = [], 0
            for lo, end in runs:
                kept.append(b[at:lo])
                at = end
            rest = b"".join([*kept, b[at:]])
            rows.append((doc.as_py(), len(b), len(b) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
            held += len(rest)
            if held >= BATCH:
                yield told()
                held = 0
    yield told()


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, the hash of the remaining bytes
    and ``text``, those bytes as UTF-8 (a character that a cut divides becomes U+FFFD)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = packed(docs)
    spans = repeated_spans(docs, text, group).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "end")).alias("spans"))
    joined = text.join(spans, _same(text, spans), "left").select(text["doc_id"], "z", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
