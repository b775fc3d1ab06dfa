"""A small convolutional network over bytes, in numpy.

Filters of several widths slide over one-hot bytes (a filter of width w is w tables
of 256 weights), plus one input channel that marks bytes inside a short-range repeat.
Each filter's largest value within a window, rectified, feeds a softmax layer. A
document is cut into overlapping windows that cover all its bytes, and its
probabilities are the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTHS = (2, 3, 4, 6)
FILTERS = 12
WINDOW, STRIDE = 512, 448
REPEAT_LAGS = range(2, 33)
#: Bytes and windows that are taken through the network at once.
PIECE = 1 << 18


def starts_of(n: int) -> np.ndarray:
    """Starts of the windows over n bytes: the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    at = np.arange(0, n - WINDOW, STRIDE, dtype=np.int64)
    return np.append(at, n - WINDOW)


def repeats(b: np.ndarray) -> np.ndarray:
    """1 where the four bytes from here on also began a few bytes before."""
    out = np.zeros(len(b), bool)
    if len(b) > 4:
        x = b.astype(np.uint32)
        key = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
        blank = (b[:-3] == 0) | (b[3:] == 0)
        for lag in REPEAT_LAGS:
            if lag < len(key):
                out[lag : len(key)] |= key[lag:] == key[:-lag]
        out[: len(key)] &= ~blank
    return out.astype(np.float32)


class ByteCNN:
    def __init__(self, labels: list, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.marks = [rng.normal(0, 0.3, FILTERS).astype(np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def convolved(self, b: np.ndarray) -> Iterator[np.ndarray]:
        """The filters' values at every byte, one array for each width; b ends in padding."""
        flags = repeats(b)
        n = len(b) - max(WIDTHS)
        for tables, mark in zip(self.tables, self.marks, strict=True):
            x = tables[0][b[:n]]
            for k in range(1, len(tables)):
                x += tables[k][b[k : n + k]]
            x += flags[:n, None] * mark
            yield x

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def windows(self, b: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probabilities of the windows [at, end) of b."""
        cut = np.ravel(np.column_stack([at, end]))
        return self.softmax(np.hstack([np.maximum.reduceat(x, np.minimum(cut, len(x) - 1), axis=0)[::2] for x in self.convolved(b)]))

    def documents(self, texts: Iterator[bytes]) -> Iterator[np.ndarray]:
        """Each text's mean probabilities over its windows; zeros if it has none."""
        pad = bytes(max(WIDTHS))
        held: list[bytes] = []
        spans: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        sums: dict[int, np.ndarray] = {}
        counts: list[int] = []
        ready = 0

        def flush() -> None:
            nonlocal size
            if spans:
                p = self.windows(np.frombuffer(b"".join(held) + pad, np.uint8), np.concatenate([s for _, s, _ in spans]), np.concatenate([e for _, _, e in spans]))
                k = 0
                for doc, s, _ in spans:
                    sums[doc] = sums.get(doc, 0) + p[k : k + len(s)].sum(0, dtype=np.float64)
                    k += len(s)
            held.clear(), spans.clear()
            size = 0

        for doc, text in enumerate(texts):
            at = starts_of(len(text))
            counts.append(len(at))
            step = PIECE // STRIDE
            for k in range(0, len(at), step):
                part = at[k : k + step]
                lo, hi = int(part[0]), min(int(part[-1]) + WINDOW, len(text))
                spans.append((doc, part - lo + size, np.minimum(part + WINDOW, len(text)) - lo + size))
                held += [text[lo:hi], pad]
                size += hi - lo + len(pad)
                if size >= PIECE:
                    flush()
            if not spans:
                for ready in range(ready, doc + 1):
                    yield sums.pop(ready, np.zeros(len(self.labels))) / max(counts[ready], 1)
                ready += 1
        flush()
        for ready in range(ready, len(counts)):
            yield sums.pop(ready, np.zeros(len(self.labels))) / max(counts[ready], 1)

    def fit(self, windows: list[bytes], labels: list[int], epochs: int = 4, steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam on cross entropy, every label weighing the same; gradients reach a filter
        through its largest value alone. At least ``steps`` batches are taken. A fifth of
        the windows are cut to a few bytes, so that short texts are known too."""
        rng = np.random.default_rng(seed)
        pad = max(WIDTHS)
        x = np.zeros((len(windows), WINDOW + pad), np.uint8)
        for k, b in enumerate(windows):
            x[k, : len(b)] = np.frombuffer(b[:WINDOW], np.uint8)
        sizes = np.array([min(max(len(b), 1), WINDOW) for b in windows])
        y = np.asarray(labels)
        counts = np.bincount(y, minlength=len(self.labels))
        weight = (len(y) / (np.maximum(counts, 1) * max(1, np.count_nonzero(counts)))).astype(np.float32)
        epochs = max(epochs, -(-steps // max(1, len(y) // batch)))
        params = [*self.tables, *self.marks, self.out, self.bias]
        first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                m, width = len(rows), WINDOW + pad
                size = np.where(rng.random(m) < 0.2, np.minimum(sizes[rows], rng.integers(6, 96, m)), sizes[rows])
                outside = np.arange(width) >= size[:, None]
                flat = np.where(outside, 0, x[rows]).astype(np.uint8).ravel()
                flags = repeats(flat)
                pooled, best = [], []
                for c in self.convolved(np.append(flat, np.zeros(pad, np.uint8))):
                    c = c.reshape(m, width, FILTERS)[:, :WINDOW]
                    c[outside[:, :WINDOW]] = -1e9
                    at = c.argmax(1)
                    pooled.append(np.take_along_axis(c, at[:, None], 1)[:, 0])
                    best.append(at + (np.arange(m) * width)[:, None])
                h = np.hstack(pooled)
                p = self.softmax(h)
                p[np.arange(m), y[rows]] -= 1
                p *= weight[y[rows]][:, None] / m
                active = np.maximum(h, 0)
                back = (p @ self.out.T) * (h > 0)
                grads = [np.zeros_like(q) for q in params]
                grads[-2], grads[-1] = active.T @ p, p.sum(0)
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), g.shape)
                    for k in range(w):
                        np.add.at(grads[i][k], (flat[np.minimum(best[i] + k, len(flat) - 1)], f), g)
                    grads[len(WIDTHS) + i] = (flags[best[i]] * g).sum(0)
                turn += 1
                for q, g, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-6)
        return self
