"""Containment of benchmark items against brute force, and on awkward rows."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from marginalia.llm import decontamination


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h long, g string, key string")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").lower())
    cut = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = Counter()
    for doc, text in set(docs):
        for item, said in set(items):
            w = words(said)
            if w:
                n = min(len(w), 5)
                own = cut(w, n)
                shared = len(own & cut(words(text), n))
                if shared >= 0.8 * len(own) - 1e-9:
                    out[(doc, item, shared, len(own))] += 1
    return out


ITEM = [f"w{i}" for i in range(29)]  # 25 shingles
DOCS = [
    (1, " ".join([f"x{i}" for i in range(500)] + ITEM + ["end"] * 300)), (2, " ".join(ITEM[:24])), (3, " ".join(ITEM[:23])), (4, None), (5, ""), (6, "what is TWO plus two today"), (7, "two plus three"), (8, "w1"),
    (None, " ".join(ITEM)), (None, " ".join(ITEM[:15])), (None, " ".join(ITEM[14:])), (9, "clean"), (9, " ".join(ITEM)), (9, " ".join(ITEM)), (10, "été " * 9), (11, "w1 " * 20_000 + "two plus two"),
]
ITEMS = [(7, " ".join(ITEM)), (8, "two plus two"), (9, None), (10, "..."), (None, "été été été été été été"), (11, "w1"), (7, "another of that id with more words")]


def test_pairs_are_those_of_brute_force(spark):
    docs = docs_of(spark, [(*r, 1, "g", "k") for r in DOCS])
    told = decontamination.contained_items(docs, items_of(spark, ITEMS)).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in told) == brute(DOCS, ITEMS)
    left = decontamination.decontaminate(docs, items_of(spark, ITEMS))
    bad = {t for d, t in DOCS if brute([(d, t)], ITEMS)}
    assert left.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((d, t) for d, t in DOCS if t not in bad)


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", 0)
    told = decontamination.contained_items(docs_of(spark, [(*r, 1, "g", "k") for r in DOCS]), items_of(spark, ITEMS)).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in told) == brute(DOCS, ITEMS)


def test_nothing_in_or_against_nothing(spark):
    docs, items = docs_of(spark, [(*r, 1, "g", "k") for r in DOCS]), items_of(spark, ITEMS)
    assert decontamination.contained_items(docs, items.limit(0)).count() == decontamination.contained_items(docs.limit(0), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_only_pairs_that_meet_in_a_sketch_are_counted(spark, monkeypatch):
    docs, items = docs_of(spark, [(1, " ".join(ITEM), 1, "g", "k")]), items_of(spark, [(7, " ".join(ITEM))])
    assert decontamination.contained_items(docs, items).count() == 1
    sketches = decontamination.sketches
    monkeypatch.setattr(decontamination, "sketches", lambda *a: sketches(*a).withColumn("sketch", F.lit(False)))
    assert decontamination.contained_items(docs, items).count() == 0


def test_every_sketch_is_large_enough(spark):
    items = items_of(spark, [(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in range(1, 70)])
    told = decontamination.sketches(decontamination.item_shingles(items))
    assert all(r["n_item"] == r["item_id"] for r in told.collect())
    counts = Counter(r["item_id"] for r in told.where("sketch").collect())
    assert all(counts[n] > n - 0.8 * n - 1e-9 for n in range(1, 70))
