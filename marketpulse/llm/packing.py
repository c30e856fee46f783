"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Documents are tokenised in Arrow batches; a document longer than a sequence is
cut, first piece short. Pieces are dealt by hash to tasks of about ``PIECES_PER_TASK``
and each task packs its own, longest first: a piece goes to the open bin (or a
new one) after which the squared counts of open bins per residual gap add up to
least. Bins that a task leaves with a gap of ``LOOSE`` or more are undone, and
their pieces are counted, dealt anew to as many tasks as their number asks for and
packed again, until one task holds the last ones or a round saves less than one in
``GAIN`` of the undone bins; then the bins with a gap stay as they are. A task that
gets more than twice its share (rows repeated many times) packs them in parts, so no
packing holds more. Token ids never travel: a piece is five numbers.

A task's result depends only on the set of its pieces, so a lost executor's work
is redone alike.

Defined cases: a null text is empty and gives the end token alone; repeated rows
are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import byte_slices, plus_fields
from marketpulse.staging import stage

CAPACITY = 1024
END_TOKEN = 2
LOOSE, GAIN, MOST_ROUNDS = 16, 100, 100
PIECES_PER_TASK = 100_000
MOST_CACHED = 150_000


#: Where a space touches other white space, a text is not cut there.
TOUCHING = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


def special_strings(path: str) -> list[str]:
    """The strings of a tokenizer's special tokens."""
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


class WordIds:
    """Token ids of texts, as little-endian bytes, by a bounded cache of words.

    A byte-level pre-tokeniser always starts a token at a single space between
    two other characters, so a text can be cut there and the words' ids joined.
    The words of a batch that are not cached are encoded as one string and cut by
    the tokens' byte lengths. ``ranks`` is the vocabulary of ``path`` as base64
    lines, for the faster of the two libraries; a text that holds a special token's
    string goes to the tokenizer itself, which is loaded for the first such text.
    """

    def __init__(self, path: str, ranks: str, special: list[str] | None = None):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self.slow = path, None
        self.special = special_strings(path) if special is None else special
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = np.zeros(max(table.values()) + 1, np.int32)
        for token, i in table.items():
            self.size[i] = len(token)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.cached: dict[str, bytes] = {}

    @property
    def tokenizer(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def whole(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if t == "" or any(x in t for x in TOUCHING) or any(x in t for x in self.special) else t.split(" ") for t in texts]
        known = self.cached
        missed = Counter(w for x in cut if x for w in islice(x, 1, None) if w not in known)
        new = self.encode_words(list(missed))
        if new is None:
            return [self.whole(t) for t in texts]
        both = known | new if missed else known
        out = [self.whole(t) if x is None else self.whole(x[0]) + b"".join(map(both.__getitem__, islice(x, 1, None)))
               for t, x in zip(texts, cut)]
        if len(known) < MOST_CACHED:
            known.update((w, new[w]) for w, n in missed.items() if n > 2)
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes] | None:
        """Ids of each word with a space before it; None if a word begins or ends with white space."""
        if not words:
            return {}
        if any(w != w.strip() or not w for w in words):
            return None
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        at = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        data, places = ids.tobytes(), [0, *(4 * at).tolist()]
        return {w: data[i:j] for w, i, j in zip(words, places, places[1:])}


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, end_token: int = END_TOKEN,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) and, if asked for, the token ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    special = special_strings(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer, ranks, special)
        tail = np.array([end_token], "<u4").tobytes()
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                rows, taken = [], []
                texts = batch.column("text").to_pylist()
                for i, data in enumerate(words.encode([t or "" for t in texts])):
                    data += tail
                    n = len(data) // 4
                    at, piece = 0, 0
                    while at < n:
                        length = (n - 1) % capacity + 1 if at == 0 else capacity
                        part = data[4 * at:4 * (at + length)]
                        rows.append((piece, at, length, zlib.crc32(part), part if with_ids else None))
                        taken.append(i)
                        at, piece = at + length, piece + 1
                cols = list(zip(*rows))
                arrays = [batch.column("id").take(pa.array(taken, pa.int64())), pa.array(cols[0], pa.int32()),
                          *(pa.array(c, pa.int64()) for c in cols[1:4])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in cols[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given, and the gap of each bin."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; gap 0 is closed and counts nothing
    bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        # change of the sum if an open bin of gap g goes to g - n; a bin that closes counts no more
        cost = 2 * (count[:capacity - n + 1] - count[n:]) + 2
        cost[0] = 1 - 2 * count[n]
        cost[count[n:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[capacity - n] + 1 if n < capacity else 0
        best = int(cost.argmin()) if n < capacity else -1
        if best >= 0 and cost[best] <= fresh and count[best + n]:
            gap = best + n
            b = bins_at[gap].pop()
            count[gap] -= 1
        else:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        bin_of[i], offset[i] = b, capacity - gap
        gaps[b] = gap - n
        if gap > n:
            count[gap - n] += 1
            bins_at[gap - n].append(b)
    return bin_of, offset, np.array(gaps, np.int64)


def _pack_once(pieces: DataFrame, tasks: int, number: int, capacity: int, most: int) -> DataFrame:
    """One round: the pieces with sequence_id, offset and loose (its bin is to be undone); ``most`` pieces are packed at a time."""
    schema = plus_fields(pieces.schema, ("sequence_id", "long"), ("offset", "long"), ("loose", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, used = (number << 56) + (TaskContext.get().partitionId() << 32), 0
        for rows in _parts(batches, most):
            bins, offset, gaps = sum_of_squares(rows.column("length").to_numpy(), capacity)
            loose = (gaps >= LOOSE)[bins] & (tasks > 1)
            for name, x in (("sequence_id", pa.array(base + used + bins, pa.int64())), ("offset", pa.array(offset, pa.int64())), ("loose", pa.array(loose))):
                rows = rows.append_column(name, x)
            used += len(gaps)
            yield from rows.to_batches()

    dealt = pieces.repartition(tasks, "id", "piece", "ids_crc32", F.lit(number)) if tasks > 1 else pieces.repartition(1)
    return dealt.sortWithinPartitions(F.desc("length"), "id", "piece", "ids_crc32").mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables of ``most`` rows and a rest."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= most:
            yield pa.Table.from_batches([*held, batch.slice(0, most - n)]).combine_chunks()
            held, batch, n = [], batch.slice(most - n), 0
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The pieces with the sequence that holds them and their offset in it.

    ``pieces``: rows (id, piece, start, length, ids_crc32), lengths 1 to ``capacity``.
    """
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    starts = F.col("offset") == 0  # one piece of each bin
    count, number, done, undone = rest.count(), 1, [], None
    while True:
        tasks = max(1, ceil(count / pieces_per_task))
        packed = stage(_pack_once(rest, tasks, number, capacity, 2 * pieces_per_task), "packed")
        bins, loose, count = packed.agg(F.count_if(starts), F.count_if(starts & F.col("loose")), F.count_if("loose")).first()
        if undone and bins >= undone[1]:
            done.append(undone[0].drop("loose"))
            break
        if undone and (undone[1] - bins) * GAIN < undone[1] or not count or number == MOST_ROUNDS:
            done.append(packed.drop("loose"))
            break
        done.append(packed.where("NOT loose").drop("loose"))
        undone, rest, number = (packed.where("loose"), loose), packed.where("loose").select(*pieces.columns), number + 1
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    for x in done:
        alone = alone.union(x)
    return alone


def packed_documents(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: a row per piece, named after ``id_col``."""
    pieces = stage(token_pieces(docs, tokenizer, ranks, capacity, END_TOKEN, id_col, text_col), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
