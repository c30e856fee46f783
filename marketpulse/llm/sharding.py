"""Shards of near equal bytes by histogram sort.

Rows have a total order: a key column, an id, and a number given when the rows are
staged. Boundaries between shards are looked for all at once: every task counts the
exact bytes and rows between candidate boundaries ("probes") in numpy, the counts
are added up, and each boundary's interval shrinks to the one bin that holds its
goal, until that bin is a single row or its edge is within the tolerance. An interval
that has shrunk to one key goes on with the ids of that key, then with the row
numbers, so a key with a third of all rows is cut like any other. A round sends at
most ``MOST_EDGES`` numbers to the driver, whatever the input.

Further boundaries, evenly spaced in rows, cut the shards into parts of about
``ROWS_PER_PART`` rows. Since the counts below every boundary are known, one exchange
(a part is one partition) and a sort inside the parts give each row its place in its
shard, and no task holds a shard.

Defined cases: a null text is empty and weighs one byte, as an empty one does; rows
with equal texts are neighbours in the order, so they part only where a boundary
falls between them; null ids come before others of the same text; rows equal in
text and id are interchangeable; an empty table gives an empty result; a table with
fewer rows than shards leaves shards empty; other columns are carried by
``histogram_shards`` whatever they are called and not read by ``shard_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from marketpulse.llm.common import free_name, plus_fields, text_or_empty
from marketpulse.staging import stage

PROBES, MOST_EDGES, MOST_ROUNDS = 1024, 1 << 16, 200
ROWS_PER_PART = 1_000_000
BYTES, ROWS = 0, 1
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Cut:
    """A boundary that is looked for: the least row, in order, up to which ``of`` times the measure reaches ``goal``."""

    measure: int
    goal: int
    of: int
    slack: float = 0.0
    prefix: tuple = ()  # keys of the levels above
    lo: int = LEAST
    hi: int = MOST
    below: tuple = (0, 0)  # bytes and rows before the interval
    lower: tuple | None = None  # the last row known to lie before the interval, as a key prefix
    found: tuple | None = None  # rows up to this key prefix lie left of the boundary
    left: tuple = (0, 0)  # bytes and rows left of it

    def narrow(self, bins: list[tuple]) -> None:
        """bins: (bytes, rows, least key, greatest key) of the interval's rows in order of keys."""
        before = self.below
        lower = self.lower
        for b in bins:
            after = (before[0] + b[0], before[1] + b[1])
            if self.of * after[self.measure] >= self.goal or b is bins[-1]:
                break
            before, lower = after, (*self.prefix, b[3])
        over, under = after[self.measure] - self.goal / self.of, self.goal / self.of - before[self.measure]
        if b[1] == 1 or abs(over) <= self.slack:
            self.found, self.left = (*self.prefix, b[3]), after
        elif lower is not None and abs(under) <= self.slack:
            self.found, self.left = lower, before
        elif b[2] == b[3]:
            self.prefix, self.lo, self.hi, self.below, self.lower = (*self.prefix, b[2]), LEAST, MOST, before, lower
        else:
            self.lo, self.hi, self.below, self.lower = b[2], b[3], before, lower


def _edges(lo: int, hi: int, n: int) -> np.ndarray:
    """Inclusive upper ends of at most ``n`` equal bins of [lo, hi]."""
    width = hi - lo + 1
    n = min(n, width)
    return np.array([lo + width * (i + 1) // n - 1 for i in range(n)], np.int64)


def _counted(staged: DataFrame, keys: list[str], size: str, items: list[tuple]) -> dict[int, list[tuple]]:
    """For each item (prefix, lo, edges) its filled bins, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((2, len(edges)), np.int64) for _, _, edges in items]
        ends = [(np.full(len(edges), MOST), np.full(len(edges), LEAST)) for _, _, edges in items]
        los = np.array([prefix[0] if prefix else lo for prefix, lo, _ in items], np.int64)
        his = np.array([prefix[0] if prefix else edges[-1] for prefix, _, edges in items], np.int64)
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys) + 1)]
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            begins, stops = np.searchsorted(columns[0], los, "left"), np.searchsorted(columns[0], his, "right")
            for j in np.flatnonzero(begins < stops):
                (prefix, lo, edges), total, (least, greatest) = items[j], totals[j], ends[j]
                x, weights = columns[len(prefix)][begins[j]:stops[j]], columns[-1][begins[j]:stops[j]]
                if prefix:
                    take = (x >= lo) & (x <= edges[-1])
                    for c, v in zip(columns[1:], prefix[1:]):
                        take &= c[begins[j]:stops[j]] == v
                    x, weights = x[take], weights[take]
                    order = np.argsort(x, kind="stable")
                    x, weights = x[order], weights[order]
                place = np.searchsorted(edges, x)
                cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(x) else np.zeros(0, int)
                if len(cut):
                    at, after = place[cut], np.append(cut[1:], len(x))
                    total[0, at] += np.add.reduceat(weights, cut)
                    total[1, at] += after - cut
                    least[at], greatest[at] = np.minimum(least[at], x[cut]), np.maximum(greatest[at], x[after - 1])
        for i, (total, (least, greatest)) in enumerate(zip(totals, ends)):
            some = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int64)), pa.array(some), *(pa.array(x[some]) for x in (*total, least, greatest))],
                                             ["item", "bin", "bytes", "n", "least", "greatest"])

    found = (staged.select(*keys, size).mapInArrow(count, "item long, bin long, bytes long, n long, least long, greatest long").groupBy("item", "bin")
             .agg(F.sum("bytes"), F.sum("n"), F.min("least"), F.max("greatest")).collect())  # at most MOST_EDGES rows and a bin per item
    out: dict[int, list[tuple]] = {}
    for r in sorted(found):
        out.setdefault(r[0], []).append(tuple(r[2:]))
    return out


def find_cuts(staged: DataFrame, keys: list[str], size: str, cuts: list[Cut], probes: int = PROBES) -> None:
    """Shrink every cut's interval until it is found. The last of ``keys`` is unique; ``size`` is a long."""
    for _ in range(MOST_ROUNDS):
        open_ = [c for c in cuts if c.found is None]
        if not open_:
            return
        places = {x: i for i, x in enumerate(dict.fromkeys((c.prefix, c.lo, c.hi) for c in open_))}
        n = max(2, min(probes, MOST_EDGES // len(places)))
        bins = _counted(staged, keys, size, [(prefix, lo, _edges(lo, hi, n)) for prefix, lo, hi in places])
        for c in open_:
            c.narrow(bins[places[c.prefix, c.lo, c.hi]])
    raise RuntimeError("boundaries were not found: the last key is not unique")


def _parts_of(columns: list[np.ndarray], ends: list[tuple]) -> np.ndarray:
    """Number of boundaries that lie before each row: those whose left side does not hold it."""
    first = np.array([e[0] for e in ends], np.int64)
    part = np.searchsorted(first, columns[0], "left")
    upto = np.searchsorted(first, columns[0], "right")
    rows = np.flatnonzero(part < upto)  # rows on a boundary's first key
    for j in np.unique(np.concatenate([np.arange(a, b) for a, b in set(zip(part[rows].tolist(), upto[rows].tolist()))])) if len(rows) else ():
        mine = rows[columns[0][rows] == first[j]]
        beyond, same = np.zeros(len(mine), bool), np.ones(len(mine), bool)
        for c, v in zip(columns, ends[j]):
            beyond |= same & (c[mine] > v)
            same &= c[mine] == v
        part[mine] += beyond
    return part


def histogram_shards(rows: DataFrame, key: Column, id_key: Column, size: Column, shards: int, tolerance: float = 0.0,
                     rows_per_part: int = ROWS_PER_PART, shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """``rows`` with their shard and their place in it (gapless from 0), dealt and sorted.

    ``key`` and ``id_key`` are longs that order the rows, ``size`` a positive long. A
    shard's end is off its goal by ``tolerance`` of a shard at most, or by the row that
    stands on it. A partition of the result is a part of one shard, in order.
    """
    names = [free_name(rows, x) for x in ("order_key", "order_null", "order_id", "order_row")]
    weight, part = free_name(rows, "order_size"), free_name(rows, "order_part")
    shard_name, slot_name = free_name(rows, shard_name), free_name(rows, slot_name)
    staged = stage(rows.withColumns({names[0]: key, names[1]: F.when(id_key.isNull(), 0).otherwise(1).cast("long"), names[2]: F.coalesce(id_key, F.lit(0)).cast("long"),
                                     names[3]: F.monotonically_increasing_id(), weight: size.cast("long")}), "to-shard")
    total, n = staged.agg(F.sum(weight), F.count("*")).first()
    ends = [Cut(BYTES, k * total, shards, tolerance * total / shards) for k in range(1, shards)] if n else []
    inner = [Cut(ROWS, k * n, parts, 0.1 * n / parts) for parts in [ceil(n / rows_per_part)] for k in range(1, parts)]
    find_cuts(staged, names, weight, ends + inner)
    whole = (MOST,) * len(names)
    borders = sorted({(c.found + whole)[:len(names)] for c in ends + inner})
    known = {(c.found + whole)[:len(names)]: c.left[ROWS] for c in ends + inner}
    starts = np.array([0, *(known[b] for b in borders)], np.int64)  # rows before each part
    shard_ends = [(c.found + whole)[:len(names)] for c in ends]
    shard_of = np.array([sum(e <= b for e in shard_ends) for b in [(LEAST,) * len(names), *borders]], np.int32)
    first_part = np.searchsorted(shard_of, shard_of, "left")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(x)).to_numpy(zero_copy_only=False) for x in names]
            found = _parts_of(columns, borders) if borders else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], [*batch.schema.names, part])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = -1, 0
        for batch in batches:
            parts = batch.column(width + len(names) + 1).to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[parts[0] != last], parts[1:] != parts[:-1]]) if len(parts) else np.zeros(0, bool)
            at = np.arange(len(parts))
            index = at - np.maximum.accumulate(np.where(fresh, at, 0)) + np.where(np.cumsum(fresh) == 0, place, 0)
            slots = starts[parts] + index - starts[first_part[parts]]
            if len(parts):
                last, place = int(parts[-1]), int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(shard_of[parts]), pa.array(slots)], [*batch.schema.names[:width], shard_name, slot_name])

    width = len(rows.columns)
    return (staged.mapInArrow(deal, plus_fields(staged.schema, (part, "integer")))
            .repartitionById(max(1, len(borders) + 1), F.col(part)).sortWithinPartitions(part, *names)
            .mapInArrow(number, plus_fields(rows.schema, (shard_name, "integer"), (slot_name, "long"))))


def text_key(text_col: str = "text") -> Column:
    """60 bits of the text's MD5: spreads texts evenly and keeps equal ones together."""
    return F.conv(F.substring(F.md5(text_or_empty(text_col).cast("binary")), 1, 15), 16, 10).cast("long")


def id_order(docs: DataFrame, id_col: str) -> Column:
    """Integer ids by value, others by a hash."""
    return F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text",
                    rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Per row: id, size (UTF-8 bytes and one), text_crc32, shard and slot. Texts are reduced to these before they move."""
    data = text_or_empty(text_col).cast("binary")
    slim = docs.select(F.col(id_col).alias(id_col), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                       text_key(text_col).alias("text_key"))
    out = histogram_shards(slim, F.col("text_key"), id_order(docs, id_col), F.col("size"), shards, tolerance, rows_per_part)
    return out.drop("text_key")


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text",
                 rows_per_part: int = ROWS_PER_PART) -> None:
    """Whole rows as parquet, a folder per shard; inside it, files hold parts of the shard in order."""
    name = free_name(docs, "shard")
    size = (F.octet_length(text_or_empty(text_col)) + 1).cast("long")
    histogram_shards(docs, text_key(text_col), id_order(docs, id_col), size, shards, tolerance, rows_per_part).write.partitionBy(name).parquet(path)
