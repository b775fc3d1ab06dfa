"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from marginalia.llm import resampling

LONG = "Word " * 30_000


def brute(docs, target, percent=10, min_words=20, buckets=10_000, longest=1, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    told = [(d, *features(t)) for d, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in told:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d, n, f in told:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    ranks = [(d, f, w, s, k + 1) for k, (d, _, f, w, s) in enumerate(drawn)]
    for r in drawn:
        rows.remove(r)
    return sorted([*ranks, *((d, f, w, s, None) for d, _, f, w, s in rows)], key=str)


def told(spark, docs, target, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), **how).collect()), key=str)


def texts(n):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Éte", "été", "İK", "日本"]
    return [(k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(n)]


TARGET = ["w1 w2 w3 W4 w5", "été w1 w1", None, ""]


@pytest.mark.parametrize("how", [{}, {"percent": 50}, {"percent": 100, "min_words": 0}, {"percent": 0}, {"longest": 3, "buckets": 97}, {"percent": 37, "accuracy": 2}, {"percent": 3, "accuracy": 1}])
def test_drawn_documents_and_ranks(spark, how):
    docs = texts(400)
    assert told(spark, docs, TARGET, **how) == brute(docs, TARGET, **{k: v for k, v in how.items() if k != "accuracy"})


def test_awkward_rows(spark):
    docs = [*texts(60), (None, "a b c " * 10), (None, "a b c " * 10), (1, None), (2, ""), (3, " \n\x00"), (4, LONG), *[(7, "same words here " * 9)] * 40]
    assert told(spark, docs, TARGET, percent=60) == brute(docs, TARGET, percent=60)
    assert told(spark, [], TARGET) == [] and told(spark, [(1, None)], []) == [(1, 0, 0, told(spark, [(1, None)], [])[0][3], None)]
    assert {r[4] for r in told(spark, docs, [])} >= {1, 2, 3}


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(texts(50), "doc_id long, text string").selectExpr("*", "'x' as score", "1 as w", "2 as f", "3 as row", "4 as rank", "5 as total", "6 as __range")
    assert sorted(map(tuple, resampling.resampled(docs, spark.createDataFrame([(TARGET[0],)], "text string")).collect()), key=str) == brute(texts(50), TARGET[:1])


def test_the_bracket_is_validated_and_widened(spark):
    """A sketch that is far off gives a bracket that misses the place; counts outside tell."""
    rows = spark.range(5000).selectExpr("cast(id * id % 4999 as long) as score")
    have = sorted((r["score"] for r in rows.collect()), reverse=True)
    for accuracy in (1, 2, 50, 1000):
        for wanted in (1, 77, 2500, 4999, 5000):
            lo, hi, above = resampling.bracket(rows, wanted, 5000, accuracy)
            assert lo <= have[wanted - 1] <= hi and above == sum(s > hi for s in have) < wanted
    lo, hi, _ = resampling.bracket(rows, 500, 5000)
    assert sum(lo <= s <= hi for s in have) < 100
