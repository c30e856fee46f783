"""Counting quotient filters as exact counters, and phrases against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketpulse.llm import phrases
from odd import nothing, odd  # noqa: F401


@pytest.mark.parametrize("bits", [1, 2, 7, 16, 17, 21, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_permutation_is_undone(n, bits):
    rng = np.random.default_rng(n * bits)
    columns = [rng.integers(0, 1 << bits, 1000) for _ in range(n)]
    shape = phrases.Shape(n, bits)
    high, low = shape.permute(*shape.pack(columns))
    assert (high <= shape.mask).all() and (low <= shape.mask).all()
    assert all((a == b).all() for a, b in zip(columns, shape.unpack(*shape.restore(high, low))))
    distinct = len(set(zip(*(c.tolist() for c in columns))))
    assert len(set(zip(high.tolist(), low.tolist()))) == distinct


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 4), st.sampled_from([1, 3, 16, 17, 20, 32]), st.integers(0, 9), st.lists(st.tuples(st.integers(0, 50), st.sampled_from([1, 2, 3, 256, 257, 258, 10**12])), max_size=300))
def test_filters_keep_entries_and_counts(n, bits, known, entries):
    shape = phrases.Shape(n, bits)
    known = min(known, shape.half)
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << bits, (51, n))
    want = Counter()
    for i, c in entries:
        want[tuple(pool[i].tolist())] += c
    columns = [np.array([pool[i][k] for i, _ in entries], np.int64) for k in range(n)]
    rows = phrases.summed(*shape.permute(*shape.pack(columns)), np.array([c for _, c in entries], np.int64), shape.half)
    got = Counter()
    for part, data in phrases.slices(*rows, shape.half, known):
        high, low, counts = phrases.decode(data, shape.half, known, part)
        for key, c in zip(zip(*(x.tolist() for x in shape.unpack(*shape.restore(high, low)))), counts.tolist()):
            got[key] += c
    assert got == want


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    shape = phrases.Shape(2, 17)
    rows = phrases.summed(*shape.permute(*shape.pack([rng.integers(1, 1 << 17, 500_000) for _ in range(2)])), np.ones(500_000, np.int64), shape.half)
    assert len(phrases.encode(*rows, shape.half, 0)) < 2.5 * len(rows[0])


def by_hand(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                f[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        often = {g: c for g, c in counts.items() if c >= least}
        longer = Counter()
        for g, c in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i:i + m]] = max(longer[g[i:i + m]], c)
        found = []
        for g, a in often.items():
            if len(g) > 1 and not 100 * longer[g] >= 80 * a:
                score, _, l, r = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def collected(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_drawn_texts_in_many_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = np.array("the The of a-b x é 字 y z new york".split())
    seps = np.array([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\v", "!?"])
    rows = [([None, "en", "de"][i % 3], "".join(w + s for w, s in zip(rng.choice(words, 60), rng.choice(seps, 60)))) for i in range(90)]
    rows += [("en", "new york city hall")] * 40
    monkeypatch.setattr(phrases, "STEP_BITS", 2)
    monkeypatch.setattr(phrases, "FAN_BITS", 1)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 300)
    monkeypatch.setattr(phrases, "TASK_WORDS", 200)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert collected(phrases.phrases(df, least=4, top=50, entries=200)) == by_hand(rows, 4, 50)


def test_odd_rows(spark, odd, nothing):  # noqa: F811
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert collected(phrases.phrases(odd, least=3, top=40)) == by_hand(rows, 3, 40)
    assert phrases.phrases(nothing).count() == 0
    assert phrases.phrases(odd.where(F.col("doc_id") == 6), least=3).count() == 0
