"""Mixing, packing, WARC and the pipeline: brute force, exact round trips and oracles."""

import base64
import gzip
import hashlib
import os
import zlib
from collections import Counter
from fractions import Fraction
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from marketpulse.llm import mixing, packing, warc
from marketpulse.llm.queries import ORACLES, QUERIES, tokenizer_files
from odd import nothing, odd  # noqa: F401


def canonical(frame):
    order = sorted(frame.columns)
    return frame[order].astype(object).where(frame[order].notna(), None).map(repr).sort_values(order).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert canonical(QUERIES[name](spark, SMALL).toPandas()).equals(canonical(con.execute(ORACLES[name]).fetch_df()))


# ---- mixing ----

def test_targets_share_the_excess(spark):
    def goals(rows, total, weights):
        return {r.source: int(r.goal) / max(1, r.of) for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), total, weights).collect()}

    got = goals([("a", 10), ("b", 1000), ("c", 400)], 1410, (5, 2, 1))
    assert got["a"] == 30 and got["b"] == pytest.approx(920) and got["c"] == pytest.approx(460)
    assert sum(got.values()) == pytest.approx(1410)
    assert goals([("a", 0)], 0, (5,))["a"] == 0
    # each source that stops lets the next ones stop: shared again until none is above, by exact fractions
    rows = [(None if i == 0 else f"s{i:03d}", 3 ** (i % 9) + i) for i in range(40)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    total = sum(n for _, n in rows)
    want, left, open_ = {}, Fraction(total), dict(rows)
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if 3 * n < per * weight[s]]
        if not over:
            want.update({s: per * weight[s] for s in open_})
            break
        for s in over:
            want[s] = Fraction(3 * open_.pop(s))
            left -= want[s]
    got = goals(rows, total, (5, 2, 1))
    assert got == {s: pytest.approx(float(x)) for s, x in want.items()} and sum(want.values()) == total


def test_mix_of_more_sources_than_the_driver_takes_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    words = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 13).cast("int")), " ")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), words.alias("text"), F.concat(F.lit("host"), F.col("id") % 500).alias("source"))
    both = F.when(F.col("doc_id") % 500 < 2, F.array(F.lit("host0"), F.lit("host1"))).otherwise(F.array("source"))
    for sources in (F.array("source"), both):
        got = mixing.mixed(docs, sources).toPandas()
        taken = (got["size"] * got.copies).groupby(got.source).sum()
        size, goal = got.groupby("source").source_size.first(), got.groupby("source").target.first()
        plain = [s for s in size.index if s not in ("host0", "host1")]
        assert ((taken - goal).abs()[plain] <= 13).all() and (goal <= 3 * size)[plain].all() and got.copies.max() <= 3
        assert len(got) == 2000
    with pytest.raises(ValueError, match="several sources"):
        mixing.mixed(docs, F.array("source", F.lit("all")))


def test_cheapest_flow_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(25):
        patterns = [(tuple(s for s in "ab" if rng.random() < 0.6) or ("a",), int(rng.integers(0, 4))) for _ in range(3)]
        quotas = {s: int(rng.integers(0, 6)) for s in "ab"}
        sent = mixing.cheapest_flow(patterns, quotas, 2)

        def cost(flows):
            taken = [sum(f.values()) for f in flows]
            return sum(max(0, t - n) for t, (_, n) in zip(taken, patterns))

        best = (-1, 0)
        options = [list(product(*(range(2 * n + 1) if s in p else (0,) for s in "ab"))) for p, n in patterns]
        for choice in product(*options):
            flows = [dict(zip("ab", c)) for c in choice]
            if all(sum(f.values()) <= 2 * n for f, (_, n) in zip(flows, patterns)) and all(sum(f[s] for f in flows) <= quotas[s] for s in "ab"):
                total = sum(sum(f.values()) for f in flows)
                best = max(best, (total, -cost(flows)))
        assert (sum(sum(f.values()) for f in sent), -cost(sent)) == best


def test_mix_reaches_targets_and_repeats_rows(spark, odd, nothing, monkeypatch):  # noqa: F811
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 10 == 1, "y").otherwise("z").alias("source"),
                                    F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 17).cast("int")), " ").alias("text"))
    got = mixing.mixed(docs, F.array("source")).toPandas()
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= 17 and g.copies.max() <= 3
    again = mixing.mixed(docs.repartition(7), F.array("source")).toPandas()
    assert got.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    salted = mixing.mixed(docs, F.array("source")).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(salted.sort_values("doc_id").reset_index(drop=True))
    rows = Counter(r.doc_id for r in mixing.mix(docs, F.array("source")).collect())
    assert all(rows[r.doc_id] == (r.copies if r["size"] else 0) for _, r in got.iterrows())
    mixed = mixing.mix(odd, F.array("source"))
    assert mixed.columns == odd.columns and mixed.where("text is null").count() == 0
    assert mixing.mix(nothing, F.array("source")).count() == 0


def test_overlapping_sources_share_documents(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 300, F.array(F.lit("p"))).when(
        F.col("id") < 600, F.array(F.lit("q"), F.lit("p"))).otherwise(F.array(F.lit("q"))).alias("of"))
    got = mixing.mixed(docs, F.col("of"), weights=(1, 1)).toPandas()
    assert got.copies.tolist() == [1] * 900


def test_tokens_are_made_of_small_slices(spark, monkeypatch):
    """A worker holds the words of about a megabyte of text, and no second tokenizer for texts without special strings."""
    import pyarrow as pa

    class Rows:
        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    seen, encode = [], packing.WordIds.encode

    def noted(words, texts):
        out = encode(words, texts)
        seen.append((sum(map(len, texts)), words.slow))
        return out

    monkeypatch.setattr(packing.WordIds, "encode", noted)
    run = packing.token_pieces(Rows(), *tokenizer_files())
    batch = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": [f"plain words of text {i} " * 50 for i in range(2000)]})
    pieces = sum(b.num_rows for b in run(iter([batch])))
    assert pieces >= 2000 and sum(n for n, _ in seen) == sum(map(len, batch.column("text").to_pylist()))
    assert max(n for n, _ in seen) <= 1 << 20 and not any(slow for _, slow in seen)


# ---- packing ----

def test_token_bytes_equal_the_tokenizer(odd):  # noqa: F811
    path, ranks = tokenizer_files()
    texts = [r.text or "" for r in odd.select("text").collect()] + ["a <|endoftext|> b", "it 's  don't", " x", "x ", "a  b c", "a  b", "x\t y z"]
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").text.fillna("").tolist()
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts + docs, add_special_tokens=False)]
    words = packing.WordIds(path, ranks)
    assert words.encode(texts) + words.encode(docs) == want
    assert words.encode(docs) == want[len(texts):] and words.cached


def test_sum_of_squares_by_hand():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 300)
    bins, offset, gaps = packing.sum_of_squares(lengths, 20)
    open_bins: dict[int, int] = {}
    fill = Counter()
    for n, b, at in zip(lengths.tolist(), bins.tolist(), offset.tolist()):
        assert at == fill[b] and at + n <= 20

        def total(gap):
            after = Counter(open_bins)
            if gap < 20:
                after[gap] -= 1
            after[gap - n] += gap > n
            return sum(v * v for v in after.values())

        costs = {g: total(g) for g in [20, *(g for g, k in open_bins.items() if k and g >= n)]}
        assert costs[20 - at] == min(costs.values())
        if at:
            open_bins[20 - at] -= 1
        fill[b] += n
        if fill[b] < 20:
            open_bins[20 - fill[b]] = open_bins.get(20 - fill[b], 0) + 1
    assert [20 - fill[b] for b in range(len(gaps))] == gaps.tolist()


def check_packed(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_TOKEN]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        total += len(ids)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    assert len(sequences) <= 1.06 * (-(-total // capacity)) + 2


@pytest.mark.parametrize("per_task", [packing.PIECES_PER_TASK, 15])
def test_packing(spark, odd, nothing, monkeypatch, per_task):  # noqa: F811
    monkeypatch.setattr(packing.pack, "__defaults__", (packing.CAPACITY, per_task))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (odd, docs):
        rows = packing.packed_documents(df, *tokenizer_files()).collect()
        if df is odd or per_task > 15:
            check_packed(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert packing.packed_documents(nothing, *tokenizer_files()).count() == 0
    with_ids = packing.token_pieces(docs, *tokenizer_files(), with_ids=True).first()
    assert len(with_ids.ids) == with_ids.length and zlib.crc32(np.array(with_ids.ids, "<u4").tobytes()) == with_ids.ids_crc32


@pytest.mark.parametrize("low, high, repeats", [(513, 1008, 1), (1, 1023, 1), (20, 60, 1), (600, 601, 900)])
def test_no_packing_task_holds_more_than_twice_its_share(spark, low, high, repeats):
    lengths = np.random.default_rng(3).integers(low, high, 1200 // repeats).tolist() * repeats
    rows = [(i % (1200 // repeats), 0, 0, n, n) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, 1024, 60).collect()
    assert Counter((r.id, r.length) for r in got) == Counter((r[0], r[3]) for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    if repeats == 1:
        assert max(Counter(r.sequence_id >> 32 for r in got).values()) <= 120
    if low < 513:
        assert len(bins) <= 1.08 * sum(lengths) / 1024 + 2


# ---- WARC ----

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/3\r\nX: y", ""), (4, "u", None), (5, "u", "é" * 5000), (5, "u", "é" * 5000),
         (None, "n", "<p>x</p>"), (7, "u", "WARC/1.1\r\n\r\n"), (0, "u", "é" * 5000), (9, "u", "z" * 200_000)]


def pages(spark):
    return spark.createDataFrame([(*r, "k", 1) for r in PAGES], "page_id long, url string, html string, kind string, first int").repartition(3)


def test_warc_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(pages(spark), path, roll_bytes=300, shards=3)
    got = warc.read_warc(spark, path).collect()
    first = {}
    for i, _, html in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in PAGES)
    payload = {(i, html or "") for i, _, html in PAGES}
    for r in got:
        text = next(h for i, h in payload if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode())
        if r.record_type == "response":
            assert r.page_id == first[text] and r.refers_to is None and bytes(r.payload).decode() == text
        else:
            assert r.refers_to == first[text] and r.payload is None
    assert Counter(r.record_type for r in got)["response"] == len(first)
    files = sorted(f for f in os.listdir(path) if f.endswith(".warc.gz"))
    assert len(files) > 3 and not [f for f in os.listdir(f"{path}/temporary") if not f.startswith(".")]
    again = str(tmp_path / "again")
    warc.write_warc(pages(spark).repartition(5), again, roll_bytes=300, shards=3)
    assert {f: open(f"{path}/{f}", "rb").read() for f in files} == {f: open(f"{again}/{f}", "rb").read() for f in files}


def archive_files(path):
    return {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path) if f.endswith(".warc.gz")}


def test_warc_files_do_not_depend_on_partitions_or_settings(spark, tmp_path, monkeypatch):
    """A third of the rows lacks an id; these are cut between their digests."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    rows = [(None if i % 3 == 0 else i, f"u{i}" if i % 7 else None, f"<p>{i % 900}</p>" * (1 + i % 11)) for i in range(1800)]
    made = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for run, (parts, shuffled) in enumerate([(1, before), (1, before), (7, before), (4, "3")]):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        try:
            path = str(tmp_path / f"run{run}")
            warc.write_warc(spark.createDataFrame(rows[::-1] if run == 3 else rows, "page_id long, url string, html string").repartition(parts), path, roll_bytes=9_000)
            made.append(archive_files(path))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] == made[2] == made[3]
    manifest = spark.read.parquet(f"{path}/manifest").toPandas()
    assert manifest.records.sum() == len(rows)
    weight = sum(len(h) + warc.RECORD_BYTES for _, _, h in rows)
    per_shard = manifest.groupby(manifest.name.str[:10]).records.sum()
    assert len(per_shard) == -(-weight // 20_000) and per_shard.max() < 2 * len(rows) / len(per_shard)


@pytest.mark.parametrize("least", [0, 2])
def test_warc_keeps_each_payload_of_shared_ids(spark, tmp_path, least):
    rows = [(1, "AA"), (None, "AA"), (None, "BB"), (5, "AA"), (5, "DD"), (5, "CC"), (5, "CC"), (7, "CC"), (7, "EE"), (7, "AA"),
            (None, "FF"), (None, "FF"), (8, "x"), (None, "x")]
    path = str(tmp_path / "shared")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")), path, min_revisit=least)
    got = warc.read_warc(spark, path).collect()
    digest = {warc.base32(hashlib.sha1(h.encode()).digest()): h for _, h in rows}
    assert Counter((r.page_id, digest[r.payload_digest]) for r in got) == Counter(rows)
    full = Counter((r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response")
    want = [(1, "AA"), (None, "BB"), (5, "DD"), (5, "CC"), (7, "EE"), (None, "FF"), (8, "x"), *[(None, "x")] * (least > 1)]
    assert full == Counter(want)
    assert all((r.refers_to, digest[r.payload_digest]) in full for r in got if r.record_type == "revisit")


def test_warc_readers_trust_the_manifest_only(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(pages(spark), path)
    with open(f"{path}/part-99999-0000.warc.gz", "wb") as f:
        f.write(gzip.compress(b"junk of a lost attempt"))
    assert warc.read_warc(spark, path).count() == len(PAGES)
    for name in (f for f in os.listdir(path) if f.endswith(".warc.gz") and "99999" not in f):
        data = gzip.decompress(open(f"{path}/{name}", "rb").read())
        with open(f"{path}/{name}", "wb") as f:
            f.write(gzip.compress(data.replace(b"<p>x", b"<p>y").replace(b"zzzz", b"zzzy")))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, path).count()


def test_warc_minimum_size_and_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark), str(tmp_path / "big"), min_revisit=100)
    kinds = Counter((r.payload_bytes >= 100, r.record_type) for r in warc.read_warc(spark, str(tmp_path / "big")).collect())
    assert kinds[False, "revisit"] == 0 and kinds[True, "revisit"] == 2
    assert warc.archive(pages(spark).limit(0)).count() == 0


# ---- pipeline ----

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    good = {i for i in ids[0] if labels.get(i) == 1}
    assert len(good & ids[1]) >= 0.97 * len(good)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_on_odd_rows(spark, odd, nothing):  # noqa: F811
    for df in (odd, nothing):
        for name, step in corpus_pipeline.STAGES:
            df = corpus_pipeline.stage(step(spark, df, SMALL), "stage")
    assert df.count() == 0
