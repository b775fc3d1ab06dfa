"""Operator 6: byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens by the tokenizer's pattern in SQL. Documents are dealt
into blocks; a block sends its distinct words, packed by the hash bucket of the word,
so that a word meets all its block's and other blocks' mentions in one bucket, where
each distinct word is encoded once. The ids go back to the block in the order in which
the words came, and the block's documents look their pre-tokens up by position. The
documents themselves are shuffled once, compressed; what words cost grows with the
distinct words of each block, not with the text. A frequent word takes one entry of
each block, so no word makes a bucket large.

A block is what a task holds at once. The bytes of all texts are counted first, and there
are as many blocks as make one ``BLOCK_BYTES`` on average, whatever the number of shuffle
partitions; a longer text makes its block larger by its own length. There is a bucket for
every ``BLOCKS_PER_BUCKET`` blocks, so that a bucket holds the words of about so many. Beyond
``REGION`` blocks (some 50 GB of text) words meet within regions of so many blocks and are encoded once
in each: a bucket gets ``REGION`` rows at most, and rows grow with the blocks, not with their square.

Rows that are equal entirely would share a block. Where one occurs more than ``REPEATS`` times, its
copies are first counted within the tasks that read them; one is encoded, and its result repeated.

Decoding looks ids up in the token-byte table, whose size is the vocabulary's: what a
broadcast join with it would give, by array index. Where both are wanted, the task that places a block's
ids decodes them too, so that it needs one Python worker, not two at once.

The vocabulary is a rank file named by the caller; it is read once and broadcast (tens
of thousands of entries). Null text counts as empty and gives no ids. Columns other
than doc_id and text are ignored; repeated rows give repeated results. An input column named ``decoded`` is replaced by decoding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches, table

#: Bytes of text in a block: smaller ones take less memory, and send more words in all.
BLOCK_BYTES = 12 << 20
BLOCKS_PER_BUCKET = 4
REGION = 4096
#: Copies of a row from which on they are counted first, and rows of that kind that are broadcast.
REPEATS, BROADCAST_REPEATS = 64, 200_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 3)


def _unzip(z: bytes, kind: type | None = None):
    b = zstandard.decompress(z)
    return b if kind is None else np.frombuffer(b, kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens as compressed bytes and lengths."""
    for batch in batches:
        words = batch["tokens"].flatten().cast(pa.binary())
        each = batch["tokens"].value_lengths().fill_null(0).to_numpy()
        sizes = pc.binary_length(words).to_numpy().astype(np.uint32)
        first = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
        data = memoryview(words.buffers()[2])[first:] if len(words) else memoryview(b"")
        at = np.concatenate([[0], np.cumsum(each)])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        z = [_zip(bytes(data[ends[lo] : ends[hi]])) for lo, hi in zip(at[:-1], at[1:], strict=True)]
        lens = [_zip(sizes[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["block"], batch["n"], pa.array(z, pa.binary()), pa.array(lens, pa.binary())], ["doc_id", "block", "n", "z", "lens"])


def _block(docs: pa.Table) -> tuple[list[int], pa.LargeBinaryArray]:
    """Numbers of each document's pre-tokens, and all pre-tokens in a row."""
    lens = [_unzip(x, np.uint32) for x in docs["lens"].to_pylist()]
    each = [len(x) for x in lens]
    ends = np.zeros(sum(each) + 1, np.int64)
    np.cumsum(np.concatenate([*lens, np.zeros(0, np.uint32)]), out=ends[1:])
    data = b"".join(_unzip(x) for x in docs["z"].to_pylist())
    return each, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _by_bucket(words: list[bytes], buckets: int) -> dict[int, list[int]]:
    """Places of the distinct words in each bucket, in the words' own order."""
    out: dict[int, list[int]] = {}
    for k in sorted(range(len(words)), key=words.__getitem__):
        out.setdefault(zlib.crc32(words[k]) % buckets, []).append(k)
    return out


def _counted(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and n: rows that occur very often once with their number, all others as they are with
    n = 1; and whether there are any such."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    often = durable(docs.groupBy("doc_id", F.xxhash64("text").alias("h")).count().where(F.col("count") > REPEATS).select(F.col("doc_id").alias("__id"), "h"))
    kinds = often.count()
    if not kinds:
        return docs.withColumn("n", F.lit(1).cast("long")), False
    often = F.broadcast(often) if kinds <= BROADCAST_REPEATS else often
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("h"))
    rest = docs.join(often, same, "left_anti").withColumn("n", F.lit(1).cast("long"))
    return rest.unionByName(docs.join(often, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))), True


def _token_bytes(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens by id, and where each begins."""
    tokens = sorted(ranks, key=ranks.get)
    return b"".join(tokens), np.cumsum([0, *map(len, tokens)])


def _decoded(listed: pa.ListArray, table: tuple[bytes, np.ndarray]) -> pa.Array:
    """The bytes that each list of ids stands for."""
    data, at = table
    ids = listed.flatten().to_numpy(zero_copy_only=False)
    sizes = at[ids + 1] - at[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(data, np.uint8)[np.repeat(at[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
    cut = ends[np.concatenate([[0], np.cumsum(listed.value_lengths().fill_null(0).to_numpy())])]
    return pa.array([text[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, decoding: bool = False) -> DataFrame:
    """doc_id and ids, array<int>; with ``decoding`` also ``decoded``, the bytes that the ids stand for."""
    spark = docs.sparkSession
    small_batches(spark)
    docs, repeated = _counted(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    n = -(-min(blocks, REGION) // BLOCKS_PER_BUCKET)
    shared = spark.sparkContext.broadcast(ranks)
    looked_up = spark.sparkContext.broadcast(_token_bytes(ranks)) if decoding else None
    tokens = F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    base = docs.select("doc_id", block.alias("block"), "n", tokens.alias("tokens")).mapInArrow(_pack, "doc_id long, block int, n long, z binary, lens binary")

    def spoken(block: pa.Table) -> pa.Table:
        words = _block(block)[1].unique().to_pylist()
        buckets = _by_bucket(words, n)
        rows = [_zip(b"".join(words[k] for k in at)) for at in buckets.values()]
        lens = [_zip(np.array([len(words[k]) for k in at], np.uint32)) for at in buckets.values()]
        home = block["block"][0].as_py() if len(block) else 0
        first = home // REGION * n  # of the region's buckets
        return pa.table({"bucket": pa.array([first + b for b in buckets], pa.int32()), "block": pa.array([home] * len(rows), pa.int32()), "words": pa.array(rows, pa.binary()), "lens": pa.array(lens, pa.binary())})

    def encoded(bucket: pa.Table) -> pa.Table:
        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})._core_bpe
        known: dict[bytes, list[int]] = {}
        ids, counts = [], []
        for data, lens in zip(bucket["words"].to_pylist(), bucket["lens"].to_pylist(), strict=True):
            data, at, flat, n_ids = _unzip(data), 0, [], []
            for size in _unzip(lens, np.uint32).tolist():
                word = data[at : at + size]
                at += size
                found = known.get(word)
                if found is None:
                    found = known[word] = bpe.encode_single_piece(word)
                flat += found
                n_ids.append(len(found))
            ids.append(_zip(np.array(flat, np.uint32)))
            counts.append(_zip(np.array(n_ids, np.uint32)))
        return pa.table({"block": bucket["block"], "bucket": bucket["bucket"], "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def placed(block: pa.Table, told: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes, words = _block(block)
        words = words.dictionary_encode()
        buckets = _by_bucket(words.dictionary.to_pylist(), n)
        count = np.zeros(len(words.dictionary), np.int64)
        start = np.zeros(len(words.dictionary), np.int64)
        flat, total = [], 0
        for bucket, ids, counts in zip(told["bucket"].to_pylist(), told["ids"].to_pylist(), told["counts"].to_pylist(), strict=True):
            c = _unzip(counts, np.uint32).astype(np.int64)
            at = buckets[bucket % n]
            count[at] = c
            start[at] = total + np.cumsum(c) - c
            flat.append(_unzip(ids, np.uint32).astype(np.int32))
            total += len(flat[-1])
        flat = np.concatenate([*flat, np.zeros(0, np.int32)])
        place = np.asarray(words.indices)
        doc_ids, copies, k = block["doc_id"], block["n"], 0
        for lo in range(0, len(sizes), 256):
            part = sizes[lo : lo + 256]
            word = place[k : k + sum(part)]
            k += sum(part)
            c = count[word]
            ends = np.concatenate([[0], np.cumsum(c)])
            ids = flat[np.repeat(start[word] - ends[:-1], c) + np.arange(ends[-1])]
            offsets = ends[np.concatenate([[0], np.cumsum(part)])].astype(np.int32)
            told = [doc_ids.slice(lo, len(part)).combine_chunks(), copies.slice(lo, len(part)).combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]
            more = [_decoded(told[-1], looked_up.value)] if decoding else []
            yield pa.RecordBatch.from_arrays([*told, *more], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), *([("decoded", pa.binary())] if decoding else [])])

    def reassembled(block: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_batches(placed(block, told), schema)

    words = base.groupBy("block").applyInArrow(spoken, "bucket int, block int, words binary, lens binary")
    ids = words.groupBy("bucket").applyInArrow(encoded, "block int, bucket int, ids binary, counts binary")
    told = base.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(reassembled, "doc_id long, n long, ids array<int>" + (", decoded binary" if decoding else ""))
    if repeated:  # copies in portions over all tasks
        portions = told.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(REPEATS).cast("long")))).repartition(F.col("doc_id"), F.col("from"))
        told = portions.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + REPEATS - 1, F.col("n")))))
    return told.drop("n", "from", "copy")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The same rows with ``decoded``, the bytes that the ids stand for."""
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(_token_bytes(ranks))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part["ids"], shared.value)], [*names, "decoded"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of tokens, and hashes of the ids and of the decoded bytes."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    told = encode(docs, ranks, decoding=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
