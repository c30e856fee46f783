"""Phrases that occur often, counted losslessly in counting quotient filters.

1. Texts are cut into pieces and words in Arrow batches; runs of texts of one language
   become chunks: their distinct words with counts, and all words as numbers into
   that list. Chunks are written once and read column by column after that.
2. Words that occur ``LEAST`` times in their language get dense numbers; no other word can be
   part of a frequent phrase. Every chunk gets the numbers of its own words by a
   join, so no dictionary is sent to all tasks.
3. A task packs the numbers of each 2 to 4 neighbouring words into one integer of an
   even number of bits and permutes it by a Feistel network, which can be undone. The
   first bits are the quotient, the others the remainder, kept in full, so a filter
   counts without error. A filter holds its entries in order: the quotients as unary
   marks, the remainders in whole bytes, and counters only where a count is over one.
4. Filters are cut by their quotients' leading bits into slices and merged slice by
   slice, first blocks of tasks and coarse slices, then fewer blocks and finer slices,
   until a slice holds about ``ENTRIES`` occurrences. The permutation spreads entries
   evenly, and a phrase is one entry per filter however often it occurs.
5. Frequent entries are turned back into words. They are few (at most a thirtieth of
   the words), and scoring, dropping and ranking are joins and aggregates on them.

Defined cases: a null or empty text has no words; a null language is ``und``; a text
without separators is one piece, of any length; words are compared byte by byte after
lower-casing A to Z; repeated rows count as often as they occur; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import byte_slices
from marketpulse.llm.shingles import mixed
from marketpulse.staging import remove, shared_path, stage

LEAST, LONGEST, TOP = 30, 4, 2000
FACTOR, SHARE = 2_000_000, 80
CHUNK_WORDS, CHUNK_DISTINCT = 1 << 20, 60_000
TASK_WORDS = 1 << 20  # words whose phrases a task counts before it writes a filter
ENTRIES = 1 << 21
STEP_BITS, FAN_BITS = 7, 6  # bits by which a merge cuts slices finer, and joins blocks

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BREAK = b"\xff"  # occurs in no UTF-8 text
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
TABLE = bytes(CUTS[b] for b in LOWER)


# ---- counting quotient filters ----

class Shape:
    """How n word numbers of ``bits`` bits each are packed and permuted; the halves have ``half`` bits."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        self.half = ceil(n * bits / 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def pack(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the concatenated bits of the numbers, first number on top."""
        high, low = np.zeros(len(columns[0]), np.uint64), np.zeros(len(columns[0]), np.uint64)
        for k, c in enumerate(columns):
            at = (self.n - 1 - k) * self.bits  # the number's lowest bit
            c = c.astype(np.uint64)
            if at >= self.half:
                high |= c << np.uint64(at - self.half)
            else:
                low |= (c << np.uint64(at)) & self.mask
                if at + self.bits > self.half:
                    high |= c >> np.uint64(self.half - at)
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(self.n):
            at = (self.n - 1 - k) * self.bits
            if at >= self.half:
                c = high >> np.uint64(at - self.half)
            else:
                c = low >> np.uint64(at)
                if at + self.bits > self.half:
                    c = c | (high << np.uint64(self.half - at))
            out.append((c & np.uint64((1 << self.bits) - 1)).astype(np.int64))
        return out

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(4):
            high, low = low, high ^ (mixed(low + np.uint64(k + 1)) & self.mask)
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(3, -1, -1):
            high, low = low ^ (mixed(high + np.uint64(k + 1)) & self.mask), high
        return high, low


def _in_order(high: np.ndarray, low: np.ndarray, half: int) -> np.ndarray:
    """Order by (high, low)."""
    if 2 * half <= 64:
        return np.argsort((high << np.uint64(half)) | low, kind="stable")
    order = np.argsort(high, kind="stable")
    same = np.flatnonzero(high[order][1:] == high[order][:-1])
    if len(same):
        tied = np.union1d(same, same + 1)
        rows = order[tied]
        order[tied] = rows[np.lexsort((low[rows], high[rows]))]
    return order


def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order with their counts added up."""
    if not len(high):
        return high, low, counts
    order = _in_order(high, low, half)
    high, low, counts = high[order], low[order], counts[order]
    cut = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[cut], low[cut], np.add.reduceat(counts, cut)


def encode(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, known: int) -> bytes:
    """A filter of sorted entries whose first ``known`` bits of ``high`` are the same and not kept."""
    n, wide, total = len(high), half - known, 2 * half - known  # total: bits of an entry
    narrow = total <= 64  # then both halves are one number
    widest = total - 1 if narrow else wide
    q = min(range(max(0, min(widest, n.bit_length() + 3)) + 1), key=lambda x: 8 * n * ceil((total - x) / 8) + (1 << x))
    rest_bytes = ceil((total - q) / 8)
    high = high & np.uint64((1 << wide) - 1)
    if narrow:
        both = (high << np.uint64(half)) | low
        quotient, one, two = both >> np.uint64(total - q) if q else np.zeros(n, np.uint64), both & np.uint64((1 << (total - q)) - 1), np.zeros(n, np.uint64)
    else:
        quotient, top = high >> np.uint64(wide - q) if wide > q else high, high & np.uint64((1 << (wide - q)) - 1)
        one, two = (low, top) if half == 64 else (low | (top << np.uint64(half)), top >> np.uint64(64 - half))
    marks = np.zeros(n + (1 << q), np.uint8)
    marks[np.arange(n) + quotient.astype(np.int64)] = 1  # ones are entries, a zero ends a quotient
    rest = np.concatenate([x.astype("<u8")[:, None].view(np.uint8) for x in (one, two)], 1)
    more = counts > 1
    small = np.minimum(counts[more] - 2, 255).astype(np.uint8)
    big = counts[more][counts[more] >= 257]
    return (struct.pack("<QBB", n, q, rest_bytes) + np.packbits(marks).tobytes() + np.ascontiguousarray(rest[:, :rest_bytes]).tobytes()
            + np.packbits(more).tobytes() + small.tobytes() + big.astype("<i8").tobytes())


def decode(data: bytes, half: int, known: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries and counts of a filter whose entries' first ``known`` bits are ``prefix``."""
    n, q, rest_bytes = struct.unpack_from("<QBB", data)
    at, wide, total = 10, half - known, 2 * half - known

    def bits(count: int) -> np.ndarray:
        nonlocal at
        size = (count + 7) // 8
        out = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:count]
        at += size
        return out

    quotient = (np.flatnonzero(bits(n + (1 << q))) - np.arange(n)).astype(np.uint64)
    rest = np.zeros((n, 16), np.uint8)
    rest[:, :rest_bytes] = np.frombuffer(data, np.uint8, n * rest_bytes, at).reshape(n, rest_bytes)
    at += n * rest_bytes
    one, two = rest[:, :8].copy().view("<u8").ravel(), rest[:, 8:].copy().view("<u8").ravel()
    if total <= 64:
        both = one | (quotient << np.uint64(total - q)) if q else one
        high, low = both >> np.uint64(half), both & np.uint64((1 << half) - 1)
    else:
        low, top = (one, two) if half == 64 else (one & np.uint64((1 << half) - 1), (one >> np.uint64(half)) | (two << np.uint64(64 - half)))
        high = (quotient << np.uint64(wide - q)) | top
    if known:
        high = high | (np.uint64(prefix) << np.uint64(wide))
    more = np.flatnonzero(bits(n))
    counts = np.ones(n, np.int64)
    counts[more] = np.frombuffer(data, np.uint8, len(more), at).astype(np.int64) + 2
    over = more[counts[more] == 257]
    counts[over] = np.frombuffer(data, "<i8", len(over), at + len(more))
    return high, low, counts


def slices(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, known: int) -> Iterator[tuple[int, bytes]]:
    """(slice, filter) by the first ``known`` bits of sorted entries."""
    part = (high >> np.uint64(half - known)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
        yield int(part[a]), encode(high[a:b], low[a:b], counts[a:b], half, known)


# ---- chunks ----

class _Numbers(dict):
    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Chunk:
    def __init__(self, lang: str):
        self.lang, self.numbers, self.parts, self.words = lang, _Numbers(), [], 0

    def row(self, number: int) -> dict:
        ids = np.concatenate(self.parts)
        wide = len(self.numbers) > 65_536
        return {"chunk": number, "lang": self.lang, "words": [w.decode() for w in list(self.numbers)[1:]],
                "counts": np.bincount(ids, minlength=len(self.numbers))[1:], "wide": wide, "ids": ids.astype("<u4" if wide else "<u2").tobytes()}


CHUNKS = "chunk long, lang string, words array<string>, counts array<long>, wide boolean, ids binary"


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Texts as chunks of one language: distinct words, their counts, and all words as numbers from 1 (0 ends a piece)."""
    kind = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
                      ("wide", pa.bool_()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[str, _Chunk] = {}
        for whole in batches:
            for batch in byte_slices(whole, 1, 4 << 20):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = text.encode().translate(TABLE).replace(BREAK, b" \xff ").split() if text else ()
                    if not tokens:
                        continue
                    c = open_.get(lang) or open_.setdefault(lang, _Chunk(lang))
                    c.parts.append(np.array([c.numbers[t] for t in tokens] + [0], np.uint32))
                    c.words += len(tokens)
                    if c.words >= CHUNK_WORDS or len(c.numbers) >= CHUNK_DISTINCT:
                        yield pa.RecordBatch.from_pylist([open_.pop(lang).row(number)], kind)
                        number += 1
        for c in open_.values():
            yield pa.RecordBatch.from_pylist([c.row(number)], kind)
            number += 1

    return docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, CHUNKS)


def dense_numbers(words: DataFrame) -> DataFrame:
    """Staged rows with a further column ``number``: dense, from 1."""
    places = stage(words.withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    sizes = places.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each written partition
    return stage(places.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(starts), "part")
                 .select("lang", "word", "f", (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("number")), "phrase-words")


# ---- counting ----

FILTERS = "n int, slice long, block long, data binary"


def _filters(numbered: DataFrame, shapes: dict[int, Shape], known: int) -> DataFrame:
    """Filters of the phrases of chunks with rows (wide, ids, found): found are (place, number) of the chunk's frequent words."""
    kind = pa.schema([("n", pa.int32()), ("slice", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n_held = TaskContext.get().partitionId(), [], 0

        def flush():
            words = np.concatenate([*held, np.zeros(LONGEST, np.int64)])
            ok = words > 0
            for n, shape in shapes.items():
                all_ = ok[:len(words) - n + 1].copy()
                for k in range(1, n):
                    all_ &= ok[k:len(words) - n + 1 + k]
                at = np.flatnonzero(all_)
                high, low = shape.permute(*shape.pack([words[at + k] for k in range(n)]))
                entries = summed(high, low, np.ones(len(at), np.int64), shape.half)
                rows = [{"n": n, "slice": s, "block": block, "data": d} for s, d in slices(*entries, shape.half, min(known, shape.half))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

        for batch in batches:
            for wide, data, found in zip(*(batch.column(x) for x in ("wide", "ids", "found"))):
                ids = np.frombuffer(data.as_py(), "<u4" if wide.as_py() else "<u2").astype(np.int64)
                table = np.zeros(ids.max() + 1, np.int64)
                table[found.values.field("place").to_numpy()] = found.values.field("number").to_numpy()
                held.append(table[ids])
                n_held += len(ids)
                if n_held >= TASK_WORDS:
                    yield from flush()
                    held, n_held = [], 0
        if held:
            yield from flush()

    return numbered.select("wide", "ids", "found").mapInArrow(run, FILTERS)


def _merged(filters: DataFrame, shapes: dict[int, Shape], known: int, finer: int) -> DataFrame:
    """Filters of each (n, slice, block) as one, cut into slices of ``finer`` bits."""
    kind = pa.schema([("n", pa.int32()), ("slice", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        n, block = key[0].as_py(), key[2].as_py()
        shape, part = shapes[n], key[1].as_py()
        rows = _union(group, shape, min(known, shape.half), part)
        return pa.Table.from_pylist([{"n": n, "slice": s, "block": block, "data": d} for s, d in slices(*rows, shape.half, min(finer, shape.half))], kind)

    return filters.withColumn("block", F.shiftright("block", FAN_BITS)).groupBy("n", "slice", "block").applyInArrow(merge, FILTERS)


def _union(group: pa.Table, shape: Shape, known: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [decode(d.as_py(), shape.half, known, part) for chunk in group.column("data").chunks for d in chunk]
    return summed(*(np.concatenate(x) for x in zip(*found)), shape.half)


def frequent_phrases(numbered: DataFrame, n_words: int, occurrences: int, least: int = LEAST, entries: int = ENTRIES) -> DataFrame:
    """Rows (n, ids, f) of the phrases of 2 to ``LONGEST`` words that occur ``least`` times."""
    bits = max(1, int(n_words).bit_length())
    shapes = {n: Shape(n, bits) for n in range(2, LONGEST + 1)}
    last = max(0, ceil(log2(max(1, occurrences / entries))))
    known = min(last, STEP_BITS)
    filters = _filters(numbered, shapes, known)
    while known < last:
        finer = min(last, known + STEP_BITS)
        filters, known = _merged(filters, shapes, known, finer), finer
    kind = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("f", pa.int64())])

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shape = shapes[key[0].as_py()]
        high, low, counts = _union(group, shape, min(known, shape.half), key[1].as_py())
        often = counts >= least
        ids = np.stack(shape.unpack(*shape.restore(high[often], low[often])), 1) if often.any() else np.zeros((0, 1), np.int64)
        return pa.Table.from_arrays([pa.array(np.full(len(ids), shape.n, np.int32)), pa.array(list(ids), pa.list_(pa.int64())), pa.array(counts[often])], schema=kind)

    return filters.groupBy("n", "slice").applyInArrow(finish, "n int, ids array<long>, f long")


# ---- phrases ----

def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    path = shared_path(docs.sparkSession, "phrase-chunks")
    chunks(docs, text_col, lang_col).write.parquet(path)
    cut = docs.sparkSession.read.schema(CHUNKS).parquet(path)
    pairs = cut.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    counted = pairs.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    sizes = cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), "chunk").groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = stage(sizes, "phrase-sizes")  # a row for each language
    words = dense_numbers(counted.where(F.col("f") >= least))
    own = (cut.select("chunk", "lang", F.posexplode("words").alias("place", "word")).join(words, ["lang", "word"])
           .groupBy("chunk").agg(F.collect_list(F.struct((F.col("place") + 1).alias("place"), "number")).alias("found")))  # of one chunk, so bounded
    numbered = cut.select("chunk", "wide", "ids").join(own, "chunk")
    n_words, occurrences = words.count(), sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = stage(frequent_phrases(numbered, n_words, occurrences, least, entries), "phrase-counts")
    out = stage(ranked(often, words, sizes, top), "phrases")
    remove(docs.sparkSession, path)
    return out


def ranked(often: DataFrame, words: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """``often``: (n, ids, f) of phrases of 2 and more words; ``words``: (lang, word, f, number)."""
    parts = often.select("ids", "f").union(words.select(F.array("number"), "f"))
    cuts = often.select("ids", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("one"), F.expr("slice(ids, k + 1, n - k)").alias("two"))
    both = (cuts.join(parts.select(F.col("ids").alias("one"), F.col("f").alias("l")), "one")
            .join(parts.select(F.col("ids").alias("two"), F.col("f").alias("r")), "two"))
    score = F.expr(f"(cast(a AS DECIMAL(20, 0)) * {FACTOR}) div (cast(l AS DECIMAL(20, 0)) + r)")
    scored = (both.select("ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("ids")
              .agg(F.first("a").alias("a"), F.min("cut").alias("cut")))
    inner = (often.where("n > 2").select("f", F.explode(F.expr(
        "flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> slice(ids, i, m))))")).alias("ids")).groupBy("ids").agg(F.max("f").alias("longer")))
    stays = scored.join(inner, "ids", "left").where(F.coalesce(F.expr(f"cast(longer AS DECIMAL(20, 0)) * 100 < cast(a AS DECIMAL(20, 0)) * {SHARE}"), F.lit(True)))
    spelled = (stays.select("*", F.posexplode("ids").alias("at", "number")).join(words.select("number", "lang", "word"), "number").groupBy("ids")
               .agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("cut").alias("cut"),
                    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = spelled.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    return (flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(sizes, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
