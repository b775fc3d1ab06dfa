"""The byte network against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bytecnn, quality_classifier
from marginalia.llm.bytecnn import FILTERS, STRIDE, WIDTHS, WINDOW, ByteCNN


def plain_repeats(b: bytes) -> list[float]:
    out = [0.0] * len(b)
    for i in range(len(b) - 3):
        if b[i] and b[i + 3] and any(lag <= i and b[i : i + 4] == b[i - lag : i - lag + 4] for lag in bytecnn.REPEAT_LAGS):
            out[i] = 1.0
    return out


def plain_window(net: ByteCNN, b: bytes, start: int = 0, size: int | None = None) -> list[float]:
    """Filters may look beyond the end of a window, and a repeat may have begun before it."""
    padded, marks = b + bytes(max(WIDTHS)), plain_repeats(b) + [0.0] * max(WIDTHS)
    places = range(start, start + (len(b) if size is None else size))
    pooled = []
    for tables, mark in zip(net.tables, net.marks, strict=True):
        for f in range(FILTERS):
            pooled.append(max(sum(float(tables[k][padded[i + k]][f]) for k in range(len(tables))) + marks[i] * float(mark[f]) for i in places))
    z = [sum(max(x, 0.0) * float(net.out[j][c]) for j, x in enumerate(pooled)) + float(net.bias[c]) for c in range(len(net.labels))]
    total = sum(math.exp(v) for v in z)
    return [math.exp(v) / total for v in z]


def plain_document(net: ByteCNN, b: bytes) -> list[float]:
    if not b:
        return [0.0] * len(net.labels)
    starts = [0] if len(b) <= WINDOW else [*range(0, len(b) - WINDOW, STRIDE), len(b) - WINDOW]
    rows = [plain_window(net, b, s, min(WINDOW, len(b))) for s in starts]
    return [sum(c) / len(rows) for c in zip(*rows, strict=True)]


TEXTS = [b"", b"a", b"abc", b"the same the same the same the same", bytes(range(1, 256)), ("été " * 90).encode(), b"w" * 513, b"some more words " * 80]


def test_documents_are_scored_as_by_plain_loops():
    net = ByteCNN(["x", "y", "z"], seed=1)
    net.tables = [t * 4 for t in net.tables]
    told = list(net.documents(iter(TEXTS[:6])))
    assert np.allclose(told, [plain_document(net, b) for b in TEXTS[:6]], atol=1e-4)
    assert all(abs(p.sum() - 1) < 1e-5 for p in list(net.documents(iter(TEXTS)))[1:])


def test_long_texts_are_taken_in_pieces(monkeypatch):
    net = ByteCNN(["x", "y"], seed=1)
    whole = list(net.documents(iter(TEXTS)))
    monkeypatch.setattr(bytecnn, "PIECE", 600)
    assert np.allclose(list(net.documents(iter(TEXTS))), whole, atol=0.05)


def test_a_step_follows_the_gradient():
    """With tiny windows and one batch a step, the first step of Adam moves each weight against
    the sign of the loss's difference quotient."""
    windows, labels = [b"abcab", b"xyzxyz", b"hello you"], [0, 1, 0]
    weight = np.array([0.75, 1.5])

    def loss(net: ByteCNN) -> float:
        return float(sum(-weight[y] * math.log(plain_window(net, b)[y]) for b, y in zip(windows, labels, strict=True)) / len(labels))

    before, after = ByteCNN(["a", "b"], seed=2), ByteCNN(["a", "b"], seed=2)

    class NoCut:
        """The generator of fit(), without its random short crops."""

        def __init__(self, rng):
            self.rng = rng

        def __getattr__(self, name):
            return getattr(self.rng, name)

        def random(self, n):
            return np.ones(n)

    generator = np.random.default_rng
    np.random.default_rng = lambda seed: NoCut(generator(seed))
    try:
        after.fit(windows, labels, epochs=1, steps=1, batch=3, rate=1e-3)
    finally:
        np.random.default_rng = generator
    checked = 0
    for mine, moved in zip([*before.tables, *before.marks, before.out, before.bias], [*after.tables, *after.marks, after.out, after.bias], strict=True):
        flat, to = mine.reshape(-1), moved.reshape(-1)
        for i in np.argsort(-np.abs(to - flat))[:6]:
            kept = flat[i]
            flat[i] = kept + 1e-2
            up = loss(before)
            flat[i] = kept - 1e-2
            down = loss(before)
            flat[i] = kept
            if abs(up - down) > 1e-5:
                assert (up - down > 0) == (to[i] < kept)
                checked += 1
    assert checked > 30


def test_awkward_rows_with_a_fitted_model(spark):
    good, bad = "plain words in a row, " * 30, "#### $$$$ 0000 |||| " * 30
    rows = [(i, good if i % 2 else bad, i % 2) for i in range(40)]
    model = quality_classifier.fitted(spark.createDataFrame(rows, "doc_id long, text string, label int"), spark.createDataFrame(rows, "doc_id long, text string, label int").select("doc_id", "label"))
    odd = [(1, None), (2, ""), (3, "a"), (4, good * 300), (4, good * 300), (None, bad), (5, "\x00\x01 été 日本語")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"score": F.lit(7.0), "probabilities": F.lit("p"), "told": F.lit(1), "label": F.lit(0)})
    told = quality_classifier.scored(docs, model)
    assert set(told.columns) == set(docs.columns)
    by_id = [(r["doc_id"], round(r["score"], 4), r["probabilities"]) for r in told.collect()]
    assert len(by_id) == len(odd) and all(0 <= s <= 1 and p == "p" for _, s, p in by_id)
    assert [s for d, s, _ in by_id if d in (1, 2)] == [0.0, 0.0] and all(s > 0.5 for d, s, _ in by_id if d == 4) and all(s < 0.5 for d, s, _ in by_id if d is None)
    assert quality_classifier.scored(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [0, 1, WINDOW, WINDOW + 1, 3 * WINDOW])
def test_windows_cover_every_byte(n):
    covered = {k for s in bytecnn.starts_of(n) for k in range(s, min(s + WINDOW, n))}
    assert covered == set(range(n))
