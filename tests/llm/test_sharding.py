"""Histogram sort: order, balance, places and odd rows against a plain sort."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from marketpulse.llm import sharding
from odd import nothing, odd  # noqa: F401


def by_hand(rows, shards):
    """rows: (key, id, size) -> sorted list with shard and slot, cut exactly at row ends."""
    rows = sorted(rows)
    total, before, out, slots = sum(r[2] for r in rows), 0, [], {}
    for r in rows:
        shard = min(shards - 1, before * shards // total)
        out.append((*r, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += r[2]
    return out


def sharded(spark, rows, shards, **more):
    df = spark.createDataFrame(rows, "k long, i long, s long").repartition(5)
    return sharding.histogram_shards(df, F.col("k"), F.col("i"), F.col("s"), shards, **more)


@pytest.mark.parametrize("kind", ["even", "hot key", "hot row", "few", "narrow", "wide"])
def test_shards_are_those_of_a_plain_sort(spark, kind):
    rng = np.random.default_rng(3)
    n = 5 if kind == "few" else 3000
    key = rng.integers(-2**62, 2**62, n) if kind != "narrow" else rng.integers(0, 3, n)
    if kind == "wide":
        key = rng.choice([-2**63, 2**63 - 1, 0], n)
    ids, size = rng.permutation(n), rng.integers(1, 50, n)
    if kind in ("hot key", "hot row"):
        key[:n // 3] = 17
    if kind == "hot row":
        ids[:n // 3], size[:n // 3] = 5, 9
    rows = [tuple(map(int, r)) for r in zip(key, ids, size)]
    for parts in (100, 10**6):
        got = sorted(map(tuple, sharded(spark, rows, 7, rows_per_part=parts).collect()))
        assert got == sorted(by_hand(rows, 7))


def test_tolerance_ends_the_search_early(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), i, 10) for i, k in enumerate(rng.integers(0, 2**60, 4000))]
    got = sharded(spark, rows, 4, tolerance=0.05).groupBy("shard").agg(F.sum("s").alias("bytes"), F.max("slot").alias("last"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and all(abs(r["bytes"] - 10_000) <= 1_010 and r["last"] == r["n"] - 1 for r in got)


def test_documents_keep_copies_together(spark, odd, nothing):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sharding.shard_documents(docs, rows_per_part=40).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 for _, r in got.iterrows())
    share = got["size"].sum() / 8
    assert (abs(got.groupby("shard")["size"].sum() - share) <= got["size"].max()).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    line = got.sort_values(["shard", "slot"]).doc_id.map(texts).tolist()
    assert sum(a != b for a, b in zip(line, line[1:])) == len(set(texts.values())) - 1
    strange = sharding.shard_documents(odd).collect()
    assert len(strange) == odd.count() and {r.shard for r in strange} <= set(range(8))
    assert [r["size"] for r in strange if r.doc_id == 3] == [1]
    assert sharding.shard_documents(nothing).count() == 0
    words = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sharding.shard_documents(words).select("doc_id").distinct().count() == len(texts)


def test_written_shards_hold_whole_rows(spark, odd, tmp_path):  # noqa: F811
    path = str(tmp_path / "shards")
    sharding.write_shards(odd.select(*odd.columns, F.lit(1).alias("order_key"), F.lit("x").alias("shard")), path, shards=3)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert back.select("shard_").distinct().count() == 3
