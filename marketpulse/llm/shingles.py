"""Word shingles of whole texts as 64-bit hashes, computed in numpy for many texts at once."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, A to Z lower-cased, and the number of words of each text.

    A word's hash is a polynomial in its bytes, taken from one running sum over all bytes.
    """
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(ODD, len(data)), dtype=np.uint64)])
    h = mixed((sums[ends] - sums[starts]) * _powers(INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    return h, counts


def shingle_sets(texts: list[bytes], size: int = 5):
    """Per text the sorted distinct hashes of its shingles.

    A text with fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    h, counts = word_hashes(texts)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams[:n - k] += mixed(h[k:] + np.uint64(k + 1))
    grams = mixed(grams)
    at = 0
    for m in counts.tolist():
        if m >= size:
            yield np.unique(grams[at:at + m - size + 1])
        elif m:
            own = sum((int(mixed(h[at + k:at + k + 1] + np.uint64(k + 1))[0]) for k in range(m)), m << 32) & ((1 << 64) - 1)
            yield mixed(np.array([own], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += m
