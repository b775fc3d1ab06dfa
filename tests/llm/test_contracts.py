"""The training-data queries against SQL or brute force, and on awkward input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import byte_bpe, labelled, language_id, licenses, pii, quality_classifier, quality_rules, registry, sharding, simhash, substring_dedup
from tests.compare import assert_same

LONG = "word " * 30_000
#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash.
AWKWARD = [
    (1, None, "en", "s", 0.5, 1), (2, "", None, None, None, 2), (3, "a", "en", "s", 1.0, 3), (4, LONG, "en", "s", 1.0, 4), (5, "The same text of some words is here. " * 20, "en", "s", 1.0, 5),
    (6, "The same text of some words is here. " * 20, "en", "s", 1.0, 6), (7, "  \n\t ", "fr", "s", 1.0, 7), (8, "été à la mer\x00\x01 日本語 😀 İK", "fr", None, 1.0, 8), (9, "Licensed under the MIT License.\n", "en", "s", 1.0, 9), (9, "Licensed under the MIT License.\n", "en", "s", 1.0, 9), (None, "no id at all here", "de", "s", 1.0, 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, h long"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, data, name):
    assert_same(spark, data, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("run", [quality_rules.quality_rules, licenses.license_scan, pii.pseudonymise, substring_dedup.remove_repeats, byte_bpe.digests, sharding.shard_by_bytes, simhash.near_duplicates], ids=lambda f: f.__name__)
def test_awkward_rows_are_all_told(awkward, nothing, run):
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    assert ids(run(awkward)) == ids(awkward)
    assert run(nothing).count() == 0


# 1
def test_repeated_windows(spark):
    def brute(text):
        w = text.split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})

    texts = ["a b c a b c", "a a a", "a a a a", "x y z", "", "p q r s p q r t q r s", "a b c d " * 50]
    rows = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts_need_a_reference_of_the_language(spark):
    rng = random.Random(3)
    english = lambda: " ".join(rng.choice("the a of river and to house in was it that is for stone with on garden not people".split()) for _ in range(90))
    noise = " ".join("".join(rng.choice("XQZ0123456789") for _ in range(6)) for _ in range(90))
    rows = [(k, english(), "en") for k in range(30)] + [(30, english().title(), "en"), (31, english().upper(), "en"), (40, noise, "en"), (41, noise, "it"), (42, noise, None), (43, "short", "en")]
    told = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(told[k]["kept"] for k in range(30)) and not told[40]["kept"] and not told[40]["base_failed"]
    assert abs(told[30]["word_distance"] - told[29]["word_distance"]) < 0.1
    assert all(told[k]["kept"] and told[k]["word_distance"] is None for k in (41, 42)) and not told[43]["kept"]
    alone = quality_rules.quality_rules(spark.createDataFrame([(1, english(), "en"), (2, noise, "fr")], "doc_id long, text string, lang string")).collect()
    assert all(r["kept"] and r["word_distance"] is None for r in alone)


# 2
def test_words_in_another_order_are_no_license(spark):
    texts = ["all seats are taken and rights of way reserved for guests", "the mit press book was released last week under the old license plate", "Released under the old MIT License.", "x all rights reserved y", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, "all rights reserved"), (None, "nothing"), (3, "another text of that id")], "doc_id long, text string")
    told = {(r["doc_id"], r["n_words"]): r["labels"] for r in licenses.license_scan(docs).collect()}
    told.pop((3, 5))
    assert told == {(0, 11): "", (1, 13): "", (2, 6): "mit", (4, 0): "", (None, 3): "proprietary", (None, 1): ""}
    assert sorted(r["labels"] for r in licenses.license_scan(docs.where("doc_id = 3")).collect()) == ["", "proprietary"]


def test_identifiers_and_names(spark):
    texts = {"// SPDX-License-Identifier: MIT\nint x;": "mit", "# SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: CC-BY-NC-4.0": "cc-by-nc", "under Creative Commons Attribution 4.0": "cc-by", "GNU Lesser General Public License v2.1": "gpl,lgpl", "by the MIT Licence": "mit", "an identifier of the license": "", "SPDX-License-Identifier: none": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.license_scan(docs).orderBy("doc_id").collect()] == list(texts.values())


def test_license_blocks_across_windows(spark):
    text = "filler " * 61 + "all rights reserved " + "filler " * 200
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["labels"], row["n_base"], row["score"]) == ("proprietary", 0, 1.0)


# 5
def brute_repeats(texts: dict[int, str | None], length: int) -> dict[int, tuple]:
    data = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(b[p : p + length] for b in data.values() for p in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        hit = {q for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1 for q in range(p, p + length)}
        runs = sum(1 for q in hit if q - 1 not in hit)
        out[d] = (len(b), len(hit), runs, hashlib.sha256(bytes(x for q, x in enumerate(b) if q not in hit)).hexdigest())
    return out


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 1])
def test_repeats_are_removed_exactly(spark, documents, group):
    texts = {r["doc_id"]: r["text"] for r in documents.orderBy("doc_id").limit(60).collect()}
    line = "".join(chr(97 + zlib.crc32(str(i).encode()) % 26) for i in range(900))
    texts |= {1000: "x" * 401, 1001: "x" * 400, 1002: line + "A" + line, 1003: "B" + line[50:460], 1004: line[:399], 1005: None, 1006: "é" * 450, 1007: ("ab " * 300)[:-1]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = substring_dedup.remove_repeats(docs, group=group).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_repeats(texts, substring_dedup.LENGTH)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in rows if "\ufffd" not in r["text"])


def test_a_shared_passage_is_cut_from_every_document(spark):
    passage = " ".join(f"p{k:05d}" for k in range(60))  # 419 bytes
    own = lambda d, n: " ".join(f"d{d}x{k}" for k in range(n))
    docs = [(d, f"{own(d, 90)}\n{passage}\n{own(-d, 90)}") for d in range(1, 8)] + [(d, own(d, 180)) for d in range(10, 14)]
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[d]["n_removed"] >= 400 and passage not in rows[d]["text"] for d in range(1, 8))
    assert all((rows[d]["n_removed"], rows[d]["text"]) == (0, t) for d, t in docs[7:])


def test_repeated_rows_repeat_each_other(spark):
    docs = spark.createDataFrame([(1, "".join(map(str, range(300)))), (1, "".join(map(str, range(300)))), (2, "z" + "".join(map(str, range(300, 500))))], "doc_id long, text string")
    told = [(r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()]
    assert told == [(1, True), (1, True), (2, False)]


# 6
def test_ids_are_those_of_the_library(spark, awkward, documents, monkeypatch):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = awkward.select("doc_id", "text").union(documents.select("doc_id", "text").limit(50)).union(spark.createDataFrame([(500, "it's  a   test \n\n y\x85z 12½²٣ don't 'll"), (501, " \t\r\n  "), (502, "<|endoftext|>\x1c\x1f\x0b")], "doc_id long, text string"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((r["doc_id"], len(ids := bpe.encode_ordinary(r["text"] or "")), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())) for r in docs.collect())
    assert Counter(tuple(r) for r in byte_bpe.digests(docs).collect()) == want
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 4000)  # many blocks and buckets
    assert Counter(tuple(r) for r in byte_bpe.digests(docs).collect()) == want
    monkeypatch.setattr(byte_bpe, "REGION", 3)  # of many regions
    assert Counter(tuple(r) for r in byte_bpe.digests(docs).collect()) == want


def test_equal_rows_are_encoded_once_and_told_each_time(spark, monkeypatch):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    text, sizes = "the same words in every row " * 40, []
    docs = spark.range(100_000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text").union(spark.range(70).selectExpr("5L as doc_id", "null as text")).union(spark.createDataFrame([(6, "a b"), (6, "a b"), (5, "a b")], "doc_id long, text string"))
    counted = byte_bpe._counted
    monkeypatch.setattr(byte_bpe, "_counted", lambda d: (sizes.append(counted(d)[0].count()), counted(d))[1])
    told = Counter((r["doc_id"], r["n_tokens"]) for r in byte_bpe.digests(docs).groupBy("doc_id", "n_tokens", "ids_sha256").count().collect() for _ in range(r["count"]))
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert told == {(None, len(bpe.encode_ordinary(text))): 100_000, (5, 0): 70, (6, 2): 2, (5, 2): 1} and sizes == [5]


class FewTexts:
    """Stands in for a network: no more than so many bytes of text come at once."""

    BOUND = 8 << 20

    def documents(self, texts):
        texts = list(texts)
        assert sum(map(len, texts)) <= self.BOUND, sum(map(len, texts))
        return [np.zeros(1) for _ in texts]


def test_whole_texts_come_to_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))  # 33 MB
    pack = byte_bpe._pack

    def packed(batches):
        def small(batch):
            assert batch.nbytes <= FewTexts.BOUND, batch.nbytes
            return batch

        return pack(map(small, batches))

    monkeypatch.setattr(byte_bpe, "_pack", packed)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    for run in (lambda: byte_bpe.encode(docs, ranks).select("doc_id"), lambda: labelled.score(docs, FewTexts()).select("doc_id")):
        spark.conf.unset(name)
        assert run().distinct().count() == 3000
    try:
        spark.conf.set(name, "8000000")  # the caller's own
        run()
        assert spark.conf.get(name) in ("8000000", "8000000b")
    finally:
        spark.conf.unset(name)


def test_ids_are_decoded_by_the_task_that_places_them(awkward):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    last = byte_bpe.digests(awkward)._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "MapInArrow" not in last  # a second Python worker beside it
    both = byte_bpe.encode(awkward, ranks, decoding=True)
    apart = byte_bpe.decode(byte_bpe.encode(awkward, ranks), ranks)
    rows = lambda df: Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    assert both.columns == apart.columns == ["doc_id", "ids", "decoded"]
    assert rows(both) == rows(apart) == Counter((r["doc_id"], ids, (r["text"] or "").encode()) for r in awkward.collect() for ids in [tuple(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(r["text"] or ""))])


# 7 and 10
def test_language_of_held_out_documents(spark, data, documents):
    told = {r["doc_id"]: r for r in language_id.op7_language_id(spark, data).collect()}
    held = [(r["lang"], told[r["doc_id"]]["lang_pred"]) for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(told[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in documents.collect())
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_language_of_awkward_rows(awkward, nothing, documents):
    ids = documents.select("doc_id", "lang")
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(awkward, ids.where("doc_id > 100"), 50).collect()}
    assert told[1] == told[2] == told[7] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in told.values())
    assert language_id.identify(nothing, nothing.select("doc_id", "lang")).count() == 0


def test_quality_of_held_out_documents(spark, data):
    told = {r["doc_id"]: r for r in quality_classifier.op10_quality_classifier(spark, data).collect()}
    held = [(r["quality"], told[r["doc_id"]]) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(t["held_out"] and t["predicted"] == int(t["score"] >= 0.3) for _, t in held)
    good, bad = [t["score"] for q, t in held if q], [t["score"] for q, t in held if not q]
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_quality_without_labels_rejects_nothing(awkward, spark):
    model = quality_classifier.fitted(awkward, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality_classifier.scored(awkward, model).collect()} == {1.0}


# 8
def test_shards_are_even_and_gapless(spark, documents, awkward):
    for docs in (documents, awkward):
        rows = sharding.shard_by_bytes(docs).collect()
        by_shard: dict[int, list] = {}
        for r in rows:
            by_shard.setdefault(r["shard"], []).append(r)
        for shard, held in by_shard.items():
            assert 0 <= shard < 16 and sorted(r["slot"] for r in held) == list(range(len(held)))
        sizes, most = [sum(r["size"] for r in by_shard.get(s, [])) for s in range(16)], max(r["size"] for r in rows)
        assert max(sizes) - min(sizes) <= 2 * most
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in sharding.shard_by_bytes(documents).collect():
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "bytes", None)


def test_ranges_do_not_change_the_shards(spark, documents, monkeypatch):
    want = {tuple(r) for r in sharding.shard_by_bytes(documents).collect()}
    monkeypatch.setattr(sharding, "RANGE_BYTES", 1000)
    monkeypatch.setattr(sharding, "STRIDE", 8)
    assert {tuple(r) for r in sharding.shard_by_bytes(documents).collect()} == want
    assert {tuple(r) for r in sharding.shard_by_bytes(documents, ranges_per_shard=1, samples_per_range=2).collect()} == want


def test_a_hot_text_is_divided(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(400)] + [(i, f"text {i}") for i in range(400, 800)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in sharding.shard_by_bytes(docs).collect())
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 6


# the pipeline
def test_stages_take_effect(spark, data, documents):
    docs, counts = documents, [documents.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((r["doc_id"], len(ids := bpe.encode_ordinary(r["text"])), sha(",".join(map(str, ids)).encode()), sha(r["text"].encode())) for r in docs.collect())
    assert Counter(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()) == want


def test_stages_on_empty_documents(spark, data, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
