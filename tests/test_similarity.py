"""Tag similarity against plain Python, and how many pairs it compares."""

from __future__ import annotations

import random

import pytest

from marginalia.operators import graph

SCHEMA = "path string, tags array<string>"


def some(n: int, seed: int) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    tags = [f"t{k}" for k in range(14)]
    return [(f"n{k:03}.md", sorted({rng.choice(tags[: rng.choice([2, 5, 14])]) for _ in range(rng.randrange(6))})) for k in range(n)]


def jaccard(a, b) -> float:
    return round(len({*a} & {*b}) / len({*a} | {*b}), 6)


def nearest(rows, k: int) -> set[tuple[str, str, float]]:
    out = set()
    for p, a in rows:
        best = sorted(((-jaccard(a, b), q) for q, b in rows if q != p and {*a} & {*b}))[:k]
        out |= {(min(p, q), max(p, q), -s) for s, q in best}
    return out


@pytest.mark.parametrize(("seed", "k"), [(1, 3), (2, 1), (3, 6)])
def test_nearest_by_tags(spark, seed, k):
    rows = some(90, seed)
    assert {tuple(r) for r in graph.top_similar(spark.createDataFrame(rows, SCHEMA), k).collect()} == nearest(rows, k)


@pytest.mark.parametrize("levels", [(0.0,), (0.9, 0.6, 0.3, 0.0)])
def test_levels_do_not_change_what_is_nearest(spark, levels):
    rows = list({tuple(t): (p, t) for p, t in some(60, 7)}.values())  # classes of one note
    classes = graph.ranked_classes(spark.createDataFrame(rows, SCHEMA))
    found = {(r["a"], r["b"]): r["jaccard"] for r in graph.candidate_pairs(classes, 3, levels).collect()}
    by_class = {r["class"]: sorted(r["tags"]) for r in classes.collect()}
    assert all(s == jaccard(by_class[a], by_class[b]) for (a, b), s in found.items())
    for a, tags in by_class.items():
        best = sorted((-jaccard(tags, t), b) for b, t in by_class.items() if b != a and {*tags} & {*t})[:3]
        assert all((a, b) in found for _, b in best)


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.75, 1.0])
def test_pairs_from_a_least_similarity(spark, least):
    rows = some(70, 4)
    by: dict[tuple, list[str]] = {}
    for p, t in rows:
        if t:
            by.setdefault(tuple(t), []).append(p)
    want = {(min(min(a), min(b)), max(min(a), min(b)), jaccard(s, t)) for s, a in by.items() for t, b in by.items() if (s < t and {*s} & {*t} and jaccard(s, t) >= least) or (s == t and len(a) > 1)}
    assert {(r["a"], r["b"], r["jaccard"]) for r in graph.tag_jaccard(spark.createDataFrame(rows, SCHEMA), least).collect()} == want


def test_a_tag_of_all_sets_compares_few_pairs(spark):
    n = 5000
    classes = graph.ranked_classes(spark.range(n).selectExpr("concat('n', id) as path", "array('hot', concat('a', id % 1000), concat('b', id)) as tags"))
    assert classes.count() == n and graph.candidate_pairs(classes, 3).count() < 0.05 * n * (n - 1) / 2
