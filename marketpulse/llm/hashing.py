"""Hashed character n-grams of whole texts in numpy, and a logistic fit on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
PADDED = 2000  # grams that hold nothing, added to every text


class Grams:
    """Hashed byte n-grams of a list of texts, by one array operation per size.

    Gram hashes are polynomials in the bytes; grams that would cross the end of a
    text get bucket 0, which counts nothing.
    """

    def __init__(self, texts: list[bytes], sizes: tuple[int, ...], bits: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        pad = max(sizes)
        data = np.frombuffer(b"".join(texts) + b"\0" * pad, np.uint8)
        n = len(data) - pad
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(n) if n else np.zeros(0, np.int64)
        self.buckets, self.counts = [], np.zeros(len(texts), np.int64)
        for size in sizes:
            h = np.full(n, np.uint64(size), np.uint64)
            for j in range(size):
                h = h * MULT + data[j:j + n] + np.uint64(1)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            b = (h >> np.uint64(64 - bits)).astype(np.int32)
            b[b == 0] = 1
            b[left < size] = 0
            self.buckets.append(b)
            self.counts += np.maximum(self.lengths - size + 1, 0)

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Summed weights of each text's grams over their number, which is padded so that short texts stay near 0."""
        out = np.zeros(len(self.lengths))
        some = np.flatnonzero(self.lengths)
        if len(some):
            for b in self.buckets:
                out[some] += np.add.reduceat(weights[b], self.starts[some])
        return out / (self.counts + PADDED)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's distinct grams."""
        bits = len(weights).bit_length() - 1
        owner = np.repeat(np.arange(len(self.lengths), dtype=np.int64) << bits, self.lengths)
        found = np.unique(np.concatenate([(owner | b)[weights[b] != 0] for b in self.buckets]))
        return np.bincount(found >> bits, weights[found & (len(weights) - 1)], len(self.lengths))

    def rows(self):
        """(buckets, shares) of each text."""
        for i, (s, n) in enumerate(zip(self.starts, self.lengths)):
            found, times = np.unique(np.concatenate([b[s:s + n] for b in self.buckets]), return_counts=True)
            keep = found > 0
            yield found[keep], times[keep] / (self.counts[i] + PADDED)


class Sparse:
    """Rows of (columns, values), with the two products that a gradient needs.

    Products go over runs of rows with about ``RUN`` entries, so that what they hold
    beside the rows does not grow with them.
    """

    RUN = 1 << 20

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width = width
        self.columns = np.concatenate([r[0] for r in rows]).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([r[1] for r in rows]).astype(np.float32, copy=False) if rows else np.zeros(0, np.float32)
        self.lengths = np.array([len(r[0]) for r in rows], np.int64)
        ends = np.cumsum(self.lengths)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, len(self.columns), self.RUN), "right")) if len(rows) else np.zeros(0, int)
        places = np.concatenate([[0], ends])
        self.runs = [(i, j, int(places[i]), int(places[j])) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)])]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.lengths))
        for i, j, a, b in self.runs:
            some = np.flatnonzero(self.lengths[i:j])
            if len(some):
                starts = (np.cumsum(self.lengths[i:j]) - self.lengths[i:j])[some]
                out[i + some] = np.add.reduceat(w[self.columns[a:b]] * self.values[a:b], starts)
        return out

    def sums(self, of_rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for i, j, a, b in self.runs:
            out += np.bincount(self.columns[a:b], np.repeat(of_rows[i:j], self.lengths[i:j]) * self.values[a:b], self.width)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, steps: int = 120, ridge: float = 1e-3,
                 rate: float = 0.05, fixed_bias: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels ``y``: Adam steps on the ridged, weighted mean loss."""
    w, bias = np.zeros(x.width), fixed_bias or 0.0
    weight = weight / weight.sum()
    m, v, mb, vb = np.zeros(x.width), np.zeros(x.width), 0.0, 0.0
    for t in range(1, steps + 1):
        err = weight * (sigmoid(x.dot(w) + bias) - y)
        g, gb = x.sums(err) + ridge * w, float(err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
        w -= step * m / (np.sqrt(v) + 1e-6)
        if fixed_bias is None:
            bias -= 2 * step * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def lower_bytes(texts: list) -> list[bytes]:
    return [b" " + " ".join((t or "").lower().split()).encode() + b" " if t else b"" for t in texts]


def plus_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])
