"""Exact dedup: a two-pass Bloom filter, DataFrame operations only.

Pass one builds a blocked Bloom filter with two registers per 64-bit word: bits
set by some row, and bits set again by another. Pass two looks every row up in
the second register. A row whose bits were not all set twice has no equal and
passes straight through; only the others shuffle and are grouped exactly, so
false positives cost time and never change the result. The groups are written once, so
that the join back to the rows may split a group that holds many of them.

The filter takes ``BITS_PER_ROW`` bits per row and is broadcast, which is why a
filter covers at most ``ROWS_PER_FILTER`` rows (128 MB). A larger input is first
written once, without a shuffle, into slices of its hash range, and every slice
gets a filter of its own.

Defined cases: a null text counts as empty; equal texts are those that agree
after deleting every space, tab, line and page break; of equal texts the one
with the most code points and then the smallest id stays (null ids last). Rows
that repeat both id and text share one verdict in ``exact_groups``, and
``exact_dedup`` lets one of them through. An empty table gives an empty result.
Other columns are carried whatever they are called.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import SPACES, free_name, plus_fields, text_or_empty
from marketpulse.staging import shared_path, stage

BITS_PER_ROW = 16
ROWS_PER_FILTER = 64_000_000
WORDS_PER_CHUNK = 1024


def normal_text(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), SPACES + "+", "")


def _filter_size(rows: int) -> int:
    """Words of a filter, a whole number of chunks."""
    return max(1, ceil(rows * BITS_PER_ROW / 64 / WORDS_PER_CHUNK)) * WORDS_PER_CHUNK


def _keys(sha: Column, words: int) -> tuple[Column, Column]:
    """The word of a fingerprint and the mask of its (up to) four bits."""
    bits = F.xxhash64(sha, F.lit(1))
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]
    return F.pmod(F.xxhash64(sha), F.lit(words)), reduce(lambda a, b: a.bitwiseOR(b), one)


def repeated_filter(shas: DataFrame, words: int) -> DataFrame:
    """Rows (chunk, bits): the bits of each word that at least two rows set."""
    word, mask = _keys(F.col("sha"), words)
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("again"))

    def add(state, x):
        again = F.when(x["n"] > 1, x["mask"]).otherwise(state["seen"].bitwiseAND(x["mask"]))
        return F.struct(state["seen"].bitwiseOR(x["mask"]).alias("seen"), state["again"].bitwiseOR(again).alias("again"))

    found = (shas.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").agg(F.count("*").alias("n"))
             .groupBy("word").agg(F.aggregate(F.collect_list(F.struct("mask", "n")), zero, add, lambda s: s["again"]).alias("bits")))
    every = shas.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    slot = F.pmod("word", F.lit(WORDS_PER_CHUNK)).cast("int")
    return (found.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
            .groupBy(F.floor(F.col("word") / WORDS_PER_CHUNK).alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "bits"))).alias("slots"))
            .select("chunk", F.transform("slots", lambda x: x["bits"]).alias("bits")))


def _flagged(df: DataFrame, sha: str, rows: int, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether the row may have an equal."""
    words = _filter_size(rows)
    bloom = repeated_filter(df.select(F.col(sha).alias("sha")), words)
    word, mask = _keys(F.col(sha), words)
    chunk, slot, bits, key = (free_name(df, c) for c in ("chunk", "slot", "bits", "mask"))
    bloom = bloom.select(F.col("chunk").alias(chunk), F.col("bits").alias(bits))
    keyed = (df.withColumns({chunk: F.floor(word / WORDS_PER_CHUNK), slot: F.pmod(word, F.lit(WORDS_PER_CHUNK)).cast("int"), key: mask})
             .join(F.broadcast(bloom), chunk, "left"))
    twice = F.get(F.col(bits), F.col(slot)).bitwiseAND(F.col(key)) == F.col(key)
    return keyed.select(*df.columns, twice.alias(name))


def _slices(df: DataFrame, sha: str, rows_per_filter: int):
    """(frame, its rows) for each slice of the hash range; one slice is the frame itself."""
    rows = df.count()
    n = ceil(rows / rows_per_filter)
    if n <= 1:
        return [(df, rows)]
    part = free_name(df, "slice")
    path = shared_path(df.sparkSession, "exact-slices")
    df.withColumn(part, F.pmod(F.xxhash64(sha, F.lit(2)), F.lit(n))).write.partitionBy(part).parquet(path)
    whole = df.sparkSession.read.schema(plus_fields(df.schema, (part, "long"))).parquet(path)
    sizes = {r[0]: r[1] for r in whole.groupBy(part).count().collect()}  # one row a slice
    return [(whole.where(F.col(part) == i).drop(part), m) for i, m in sorted(sizes.items())]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rows_per_filter: int = ROWS_PER_FILTER) -> DataFrame:
    """Per row: id, keep_id, group_size, kept and text_sha256 of the normalised text."""
    slim = stage(docs.select(F.col(id_col).alias("id"), F.char_length(text_or_empty(text_col)).alias("n"),
                             F.sha2(normal_text(text_col), 256).alias("sha")), "exact-prints")
    out = []
    for part, rows in _slices(slim, "sha", rows_per_filter):
        marked = _flagged(part, "sha", rows, "maybe")
        rank = F.struct(-F.col("n"), F.col("id").isNull(), F.col("id"))
        alone = marked.where("NOT maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                 F.lit(True).alias("kept"), "sha")
        again = marked.where("maybe").select("id", "sha", rank.alias("rank"))
        best = stage(again.groupBy("sha").agg(F.min("rank").alias("best"), F.count("*").alias("group_size")), "exact-groups")
        out += [alone, again.join(best, "sha").select("id", F.col("best")["id"].alias("keep_id"), "group_size",
                                                      (F.col("rank") == F.col("best")).alias("kept"), "sha")]
    return reduce(DataFrame.union, out).select(F.col("id").alias(id_col), "keep_id", "group_size",
                                               F.coalesce("kept", F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rows_per_filter: int = ROWS_PER_FILTER) -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    ``row_number() = 1`` is pruned before the shuffle, so a group of copies that
    holds a third of all rows sends one row per task. The rows are stored with their
    fingerprints, which filter, single rows and repeated ones all read.
    """
    sha, maybe, place = (free_name(docs, c) for c in ("sha", "maybe", "place"))
    out = []
    printed = stage(docs.withColumn(sha, F.sha2(normal_text(text_col), 256)), "exact-rows", "zstd")
    for part, rows in _slices(printed, sha, rows_per_filter):
        marked = _flagged(part, sha, rows, maybe)
        order = Window.partitionBy(sha).orderBy(F.char_length(text_or_empty(text_col)).desc(), F.col(id_col).asc_nulls_last(),
                                                text_or_empty(text_col))
        again = marked.where(F.col(maybe)).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
        out += [marked.where(~F.col(maybe)).select(*docs.columns), again.select(*docs.columns)]
    return reduce(DataFrame.union, out)
