"""Periodic runs of words, found on suffix arrays.

A run is a maximal stretch of words that repeats with a smallest period q at least
``COPIES`` times and is ``LEAST`` words or longer. Many texts share one suffix array:
words are numbered per text, so no prefix is common to two texts.

1. The suffix array is refined by doubling (groups of equal prefixes are sorted by
   the rank ``h`` words on); the ranks of every step are kept and give the common
   prefix of any two suffixes, and so the LCP array.
2. Every place of the LCP array joins two neighbouring blocks of suffixes at a depth
   d (a multiway interval gives a place per further child). For each suffix i of the
   smaller block the inverse suffix array tells whether i + d or i - d is in the
   other: then a square of period d starts that no further word continues. Blocks are
   bounds in two arrays; no tree is built. Each suffix is in the smaller block of at
   most log2(n) places.
3. A square is rotated to the left as long as the period holds, which gives the run
   that it ends; squares of one run with other periods are multiples of the smallest.

Defined cases: words are numbered from 0; a null or empty text has no words and no
run; runs of different periods may overlap; repeated rows are judged each; ids of
any type are carried, null ones too; an empty table gives an empty result; columns
other than id and text are not read. Memory grows with a batch of ``BATCH_BYTES`` or,
beyond that, a single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import byte_slices, plus_fields, words_of
from marketpulse.llm.common import text_or_empty as text_of

LEAST, COPIES = 24, 3
BATCH_BYTES = 2 << 20
PAIRS = 1 << 21  # pairs of suffix and block that are looked at together


class Suffixes:
    """Suffix array of numbered words, with ranks by the first 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank]
        order = np.argsort(rank, kind="stable")
        h, sorted_rank = 1, rank[order]
        fresh = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # of a group: its first slot
        self.levels[0] = rank
        slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        while len(slots):
            members = order[slots]
            after = members + h
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            by = np.argsort(rank[members] * (n + 1) + second + 1, kind="stable")
            members, second = members[by], second[by]
            order[slots] = members
            group = rank[members]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
            rank = rank.copy()
            rank[members] = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append(rank)
            slots = slots[~(new & np.append(new[1:], True))]
            h *= 2
        self.order, self.place = order, rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``, for pairs of different ones."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + out, b + out
            inside = np.flatnonzero((x < self.n) & (y < self.n))
            same = inside[self.levels[k][x[inside]] == self.levels[k][y[inside]]]
            out[same] += 1 << k
        return out


def _reach(lcp: np.ndarray, at: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each place ``at`` the last place from it in direction ``step`` before one with a smaller (or, if not strict, equal) value."""
    n = len(lcp)
    tables = [lcp]
    while (1 << len(tables)) < n:
        t, w = tables[-1], 1 << (len(tables) - 1)
        low = t.copy()
        if step > 0:
            low[:n - w] = np.minimum(t[:n - w], t[w:])
        else:
            low[w:] = np.minimum(t[w:], t[:n - w])
        tables.append(low)
    value, x = lcp[at], at.copy()
    for k in range(len(tables) - 1, -1, -1):
        nxt = x + step
        ok = np.flatnonzero((nxt >= 0) & (nxt < n) & (nxt + step * ((1 << k) - 1) >= 0) & (nxt + step * ((1 << k) - 1) < n))
        low = tables[k][nxt[ok]]
        take = ok[low >= value[ok]] if strict else ok[low > value[ok]]
        x[take] += step << k
    return x


def branching_squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares whose period the word after them breaks."""
    if s.n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lcp = np.concatenate([[0], s.common(s.order[:-1], s.order[1:])])  # of each suffix with the one before it
    at = np.flatnonzero(lcp)
    if not len(at):
        return at, at
    first = _reach(lcp, at, -1, False) - 1  # the left block is order[first:at], the right one order[at:last + 1]
    last = _reach(lcp, at, 1, True)
    left_is_smaller = at - first <= last + 1 - at
    begin, size = np.where(left_is_smaller, first, at), np.where(left_is_smaller, at - first, last + 1 - at)
    other, stop = np.where(left_is_smaller, at, first), np.where(left_is_smaller, last, at - 1)
    starts, periods = [], []
    sums = np.cumsum(size)
    cut = 0
    while cut < len(at):
        end = max(cut + 1, int(np.searchsorted(sums, (sums[cut - 1] if cut else 0) + PAIRS, "right")))
        m = size[cut:end]
        owner = np.repeat(np.arange(cut, end), m)
        i = s.order[begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)]
        d = lcp[at[owner]]
        for j in (i + d, i - d):
            inside = np.flatnonzero((j >= 0) & (j < s.n))
            place = s.place[j[inside]]
            hit = inside[(place >= other[owner[inside]]) & (place <= stop[owner[inside]])]
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[hit])
        cut = end
    return np.concatenate(starts), np.concatenate(periods)


def word_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs, by start and period. ``words`` of different texts differ; ``first``: per word where its text begins."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    s = Suffixes(words)
    start, d = branching_squares(s)
    end = start + 2 * d
    need = np.maximum(least, copies * d)
    low = end - need  # where the run has to begin at the latest
    ok = np.flatnonzero(low >= first[start])
    ok = ok[s.common(low[ok], low[ok] + d[ok]) >= (need - d)[ok]]
    start, d, end, low = start[ok], d[ok], end[ok], low[ok]
    floor = first[start].copy()
    while len(todo := np.flatnonzero(floor < low)):
        middle = (floor[todo] + low[todo]) // 2
        holds = s.common(middle, middle + d[todo]) >= end[todo] - d[todo] - middle
        low[todo[holds]] = middle[holds]
        floor[todo[~holds]] = middle[~holds] + 1
    order = np.lexsort((d, end, low))
    low, end, d = low[order], end[order], d[order]
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (end[1:] != end[:-1])]) if len(low) else np.zeros(0, bool)
    low, end, d = low[fresh], end[fresh], d[fresh]
    order = np.lexsort((d, low))
    return low[order], (end - low)[order], d[order]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _batch_runs(texts: list) -> tuple[list, list]:
    """Per text its runs and the text that is left when repetitions go."""
    numbers = _Numbers()
    words = [(t or "").encode().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.array([numbers[w] for text in words for w in text], np.int64)
    begins = np.cumsum(lengths) - lengths
    start, length, period = word_runs(np.repeat(np.arange(len(texts)), lengths) * len(numbers) + ids, np.repeat(begins, lengths))
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    gone = np.cumsum(gone) > 0
    owner = np.searchsorted(begins + lengths, start, "right")
    runs: list[list] = [[] for _ in texts]
    for i, x, n, q in zip(owner.tolist(), (start - begins[owner]).tolist(), length.tolist(), period.tolist()):
        runs[i].append({"start": x, "length": n, "period": q})
    kept = []
    for i, w in enumerate(words):
        if runs[i]:
            g = gone[begins[i]:begins[i] + len(w)]
            w = [x for x, y in zip(w, g.tolist()) if not y]
        kept.append(b" ".join(w).decode())
    return runs, kept


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, its runs by start and period, the run of most copies (``best``) and ``collapsed``: words joined by a space, each run cut to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 1, BATCH_BYTES):
                runs, kept = _batch_runs(batch.column(1).to_pylist())
                best = [max(r, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"])) if r else None for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(kept, pa.string())],
                                                 [id_col, "runs", "best", "collapsed"])

    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    row = "start: long, length: long, period: long"
    fields = docs.sparkSession.createDataFrame([], f"runs array<struct<{row}>>, best struct<{row}>, collapsed string").schema
    schema = plus_fields(docs.select(id_col).schema)
    for f in fields:
        schema.add(f)
    return docs.select(id_col, F.col(text_col).alias(f"{text_col}_")).mapInArrow(run, schema)


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) where a tenth of the rows, by CRC of the id, repeats words from some place on; rows without an id stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = words_of(text_of(text_col))
    n, g = F.size("words"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - F.col("a")) / (3 + g % 8))
    numbered = docs.select(F.col(id_col), F.col(text_col), F.when(h % 10 == 0, words).alias("words")).withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    return numbered.select(id_col, F.when((n > 0) & F.col("a").isNotNull(), F.array_join(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))), " "))
        .otherwise(F.col(text_col)).alias(text_col))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
