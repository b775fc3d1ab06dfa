"""Near-duplicate groups against all pairs, and one row of each group."""

from __future__ import annotations

import re
from collections import Counter

import pytest
import xxhash

from marginalia.llm import simhash
from marginalia.session import setting


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("tree", [simhash.TREE, 2])
def test_groups_are_those_of_all_pairs(spark, documents, tree, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (tree,))
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(2000 + k, base.replace(f"w{k * 7} ", f"v{k} ")) for k in range(40)] + [(3000, None), (3001, ""), (3002, "ONE two"), (3003, "one TWO")]
    told = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {d: brute_fingerprint(t) for d, t in rows}
    assert {d: f for d, (f, _) in told.items()} == fps
    parent = {d: d for d in fps}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {d: c for d, (_, c) in told.items()} == {d: root(d) for d in fps}


def test_second_deal_compiles(spark):
    """Its code must stay below the 64 KB of a method: to compile it in vain took the driver hundreds of MB."""
    fps = spark.createDataFrame([(0,), (1,), (3,), (7,), (1 << 40,), (-1,)], "fp long")
    with setting(spark, "spark.sql.codegen.fallback", "false"):
        pairs = {frozenset(r) for r in simhash.links(fps, 2).where("a <> b").collect()}
    parent = {r["fp"]: r["fp"] for r in fps.collect()}
    for _ in parent:
        for a, b in map(tuple, pairs):
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert parent == {0: 0, 1: 0, 3: 0, 7: 0, 1 << 40: 0, -1: -1}


def test_long_chains_settle(spark):
    pairs = spark.range(1, 500).selectExpr("id as a", "id - 1 as b")
    assert {r["component"] for r in simhash.components(pairs).collect()} == {0}


def test_one_row_of_each_group_stays(spark):
    a, b = "some text that is only here", "another text with nothing in common at all"
    near = " ".join(f"w{i}" for i in range(400))
    rows = [(1, a), (5, a), (5, b), (7, near), (8, near.replace("w9 ", "v9 ")), (None, "no id"), (None, "no id"), (None, near), (2, "thrice"), (2, "thrice"), (2, "thrice"), (None, None), (3, ""), (4, " ")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, key string, fp long, n int")
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, a), (5, b), (7, near), (None, "no id"), (2, "thrice"), (3, "")])
    assert simhash.deduplicate(docs.limit(0)).count() == 0
