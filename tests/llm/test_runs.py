"""Periodic runs against brute force, on drawn words and on the planted documents."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from marketpulse.llm import runs
from marketpulse.llm.queries import QUERIES
from odd import nothing, odd  # noqa: F401


def runs_by_hand(words, least=24, copies=3):
    """All maximal stretches with a smallest period, by trying every period from the smallest."""
    n, found = len(words), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, copies * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((i, n_, q) for (i, n_), q in found.items())


def looped(doc_id, words):
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = looped(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found), kept)]
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=45), max_size=4), st.sampled_from([(2, 2), (4, 2), (6, 3), (24, 3)]))
def test_drawn_words(texts, rule):
    lengths = [len(t) for t in texts]
    words = np.array([100 * k + w for k, t in enumerate(texts) for w in t], np.int64)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int64) if texts else np.zeros(0, np.int64)
    got = list(zip(*(x.tolist() for x in runs.word_runs(words, first, *rule))))
    want = [(sum(lengths[:k]) + s, n, q) for k, t in enumerate(texts) for s, n, q in runs_by_hand(t, *rule)]
    assert got == sorted(want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("words", [[0] * 5000, [0, 1] * 900 + [2] + [0, 1, 2] * 300, [i % 997 for i in range(4000)], [0, 0, 1, 0, 0, 1, 0, 0, 2] * 40 + list(range(10, 40)) * 3])
def test_long_periodic_texts(words, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 500)
    got = list(zip(*(x.tolist() for x in runs.word_runs(np.array(words), np.zeros(len(words), np.int64)))))
    assert got == sorted(runs_by_hand(words), key=lambda r: (r[0], r[2]))


def test_whole_query_by_brute_force(spark):
    want = sorted(expected(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, SMALL).collect())) == want
    assert sum(w[1] > 0 for w in want) > 5


def test_odd_rows(spark, odd, nothing):  # noqa: F811
    got = runs.collapse_runs(odd)
    rows = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in got.collect()}
    for r in odd.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(words) > 1000:
            assert rows[r.doc_id, "word"] == [(0, 30_000, 1)]
            continue
        found = runs_by_hand(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert rows[r.doc_id, " ".join(w for i, w in enumerate(words) if i not in gone)] == found
    assert got.count() == odd.count() and got.columns == ["doc_id", "runs", "best", "collapsed"]
    assert runs.collapse_runs(nothing).count() == 0
    named = odd.select(F.concat(F.lit("d"), "doc_id").alias("runs_"), "text")
    assert runs.collapse_runs(named, "runs_").count() == odd.count()
    assert runs.with_loops(odd).where("doc_id IS NULL AND text IS NOT NULL").first().text == "a b c d e"
