"""The audit of sources against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import divergence

SCHEMA = "lang string, source string, text string"


def brute(docs, min_docs, top=10):
    said, often, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        said[lang, source].update(w)
        often[lang].update(set(w))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in often[lang].items() if n >= min_docs]
        whole = Counter({t: sum(said[lang, s][t] for s in sources) for t in kept})
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p = {s: share(said[lang, s]) for s in sources}
        q = share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if said[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def corpus(n):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzé"] + ["Été", "ÉTÉ", "日本", "x1y", "don't"]
    pick = lambda src: rng.choices(words, weights=[1 + (i * (src + 3)) % 7 for i in range(len(words))], k=rng.randrange(30))
    return [(rng.choice(["en", "en", "fr"]), f"s{k % 5}", " ".join(pick(k % 5)).title() if k % 9 else "") for k in range(n)]


AWKWARD = [(None, None, None), (None, "s", "a b"), ("xx", "one", "rare words only"), ("xx", "two", ""), ("en", "s9", "Word " * 20_000), ("en", "s0", "\x00 12 !"), *[("fr", "s1", "ax ax by")] * 12]


@pytest.mark.parametrize("bits", [64, 3, 1], ids=["digests", "collisions", "two digests"])
def test_the_report(spark, bits):
    docs = corpus(200) + AWKWARD
    told = divergence.audit(spark.createDataFrame(docs, SCHEMA), min_docs=5, bits=bits).collect()
    assert sorted(map(tuple, told)) == brute(docs, 5)


def test_small_blocks_and_a_shuffled_second_reading(spark, monkeypatch):
    docs = corpus(120)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 4)
    monkeypatch.setattr(divergence, "BROADCAST_DIGESTS", 0)
    told = divergence.audit(spark.createDataFrame(docs, SCHEMA), min_docs=1, top=3, bits=4).collect()
    assert sorted(map(tuple, told)) == brute(docs, 1, 3)


def test_ties_at_the_last_rank_go_to_the_smaller_text(spark):
    docs = [("en", "a", " ".join(f"t{chr(97 + k)}" for k in range(26))), ("en", "b", "zz")]
    told = divergence.audit(spark.createDataFrame(docs, SCHEMA), min_docs=1).where("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in told] == [f"t{chr(97 + k)}" for k in range(10)]


def test_nothing_and_clashing_columns(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = corpus(60)
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as w", "2 as key", "'t' as term", "3 as n", "4 as rank", "'x' as item")
    assert sorted(map(tuple, divergence.audit(frame, min_docs=2).collect())) == brute(docs, 2)


def test_shares_beyond_64_bits(spark):
    n, total, v = 10**13, 10**15, 10**6
    want = 1 + 10**9 * (n + 2) // (total + 2 * v)
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(divergence.share(df.n, df.total, df.v)).first()[0] == want
    assert divergence._shares(np.array([n, 3]), total, v).tolist() == [want, 1 + 10**9 * 5 // (total + 2 * v)]
