"""Quality, divergence and toxicity: brute-force figures, odd rows and accuracy on labels."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from marketpulse.llm import divergence, exact, hashing, quality, toxicity
from marketpulse.staging import stage
from odd import nothing, odd  # noqa: F401

DATA = SMALL.replace("sf0.001", "sf0.01")


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- divergence ----

def base_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = pd.Series(grams, dtype=object).value_counts().to_dict() if grams else {}
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_base_figures_and_reference(spark, odd):  # noqa: F811
    for df in (odd, table(spark, "documents")):
        got = divergence.distribution_rules(df).collect()
        want = [(r.doc_id, *base_figures(r.text)) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(map(repr, want))
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)


def test_distance_by_hand(spark):
    docs = table(spark, "documents", DATA)
    counts = stage(divergence.document_counts(docs), "counts")
    refs = {r.ref_lang: r for r in divergence.language_references(counts).collect()}
    rows = counts.collect()
    good = [r for r in rows if r.n_words >= divergence.MIN_WORDS and 100 * r.n_repeat_words <= 20 * r.n_words]
    for lang, ref in refs.items():
        for c in ("chars", "tokens"):
            assert list(ref[f"ref_{c}"]) == np.sum([r[c] for r in good if r.lang == lang], 0).tolist()
    texts = {r.doc_id: r for r in docs.collect()}
    for r in rows[:40]:
        assert sum(r.chars) == len(texts[r.id].text)
        tokens = re.findall(r"[^\W\d_]+", texts[r.id].text.lower())
        assert list(r.tokens[:-1]) == [tokens.count(w) for w in divergence.COMMON[r.lang]] and sum(r.tokens) == len(tokens)
    verdicts = {r.doc_id: r for r in divergence.distribution_rules(docs).collect()}

    def distance(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        return math.sqrt(max(0, sum(a * math.log2(a / c) for a, c in zip(p, m) if a) + sum(b * math.log2(b / c) for b, c in zip(q, m) if b)) / 2)

    for r in rows:
        v, ref = verdicts[r.id], refs[r.lang]
        far = distance(r.chars, ref.ref_chars) if sum(r.chars) >= divergence.MIN_CHARS else None
        off = distance(r.tokens, ref.ref_tokens) if sum(r.tokens) >= divergence.MIN_WORDS else None
        assert v.char_distance == pytest.approx(far) and v.word_distance == pytest.approx(off)
        assert v.kept == (not v.base_failed and (far or 0) <= divergence.MOST_CHAR_DISTANCE and (off or 0) <= divergence.MOST_WORD_DISTANCE)


def test_divergence_keeps_clean_documents(spark, nothing):  # noqa: F811
    m = divergence.distribution_rules(table(spark, "documents", DATA)).join(table(spark, "labels", DATA), "doc_id").where("n_words >= 50 AND NOT base_failed")
    shares = {r.quality: r.kept for r in m.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.6
    assert divergence.distribution_rules(nothing).count() == 0


# ---- toxicity ----

def test_grams_by_hand():
    texts = [b"abcabc", b"", b"ab", "héllo".encode() * 3]
    grams = hashing.Grams(texts, (2, 3), 12)
    assert [len(b) for b in grams.buckets] == [sum(map(len, texts))] * 2
    ids = {}
    for t, (found, shares) in zip(texts, grams.rows()):
        want = [t[i:i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
        assert len(found) <= len(set(want)) and shares.sum() * (len(want) + hashing.PADDED) == pytest.approx(len(want))
        ids[t] = set(found.tolist())
    assert ids[b"ab"] <= ids[b"abcabc"] and not ids[b""]
    weights = np.arange(1 << 12, dtype=float)
    assert grams.sums(weights).tolist() == [sum(ids[t]) for t in texts]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    p = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(p.doc_id, p.held_out))
    held = p[p.held_out]
    assert ((held.score >= 0.5) == held.predicted.astype(bool)).all() and held.score.between(0, 1).all()
    rank, y = held.score.rank(), held.toxic
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.95 and (held.predicted == y).mean() > 0.95


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = table(spark, "documents", DATA), table(spark, "labels", DATA)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (one[0] == two[0]).all() and one[1] == two[1]


def test_toxicity_of_odd_rows(spark, odd, nothing):  # noqa: F811
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 1, 0), (3, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[12]) == 1 and scores[3] == scores[4]
    assert toxicity.toxicity_scores(odd, labels.limit(0)).count() == len(got)
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


def test_toxicity_learns_from_texts_of_any_length(spark):
    """Whole verdicts do not hang on a length: all texts long, or only the toxic ones."""
    docs, labels = table(spark, "documents", DATA), table(spark, "labels", DATA)
    filler = " ".join(f"plain{i % 37}" for i in range(1500))
    long = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" " + filler)))
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    mixed = long.join(toxic, "doc_id", "left").withColumn("text", F.when(F.col("hit"), F.col("text")).otherwise(F.expr(f"substring(text, 1, char_length(text) - {len(filler) + 1})")))
    for df in (long, mixed):
        p = toxicity.toxicity_scores(df, labels).join(labels, "doc_id").toPandas()
        assert p[p.toxic == 1].predicted.mean() > 0.9 and p[p.toxic == 0].predicted.mean() < 0.1


def test_toxicity_with_texts_of_one_class_only(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(i, 1) for i in range(100, 110)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()} == {0}


def test_scorers_leave_their_input_as_it_was(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    before = list(docs.columns)
    quality.quality_scores(docs)
    toxicity.score(docs, (np.zeros(1 << toxicity.BITS), 0.0))
    exact.exact_dedup(docs, rows_per_filter=50).count()
    assert docs.columns == before and toxicity.toxicity_scores(docs, labels).count() == docs.count() and docs.columns == before


# ---- quality ----

def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right, given = np.array([0.95, 0.85, 0.7, 0.9]), np.array([1.0, 0.8, 0.9, 0.5])
    votes = np.stack([np.where(rng.random(len(good)) < g, np.where(rng.random(len(good)) < r, good, ~good), -1) for r, g in zip(right, given)], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, chance = quality.label_model(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.02)
    for j in range(4):
        voted = chance[j, 1, 1] + chance[j, 1, 2]
        assert voted == pytest.approx(given[j], abs=0.03) and chance[j, 1, 2] / voted == pytest.approx(right[j], abs=0.03)
    assert ((posterior[back.ravel()] >= 0.5) == good).mean() > 0.93


def test_quality_agrees_with_labels(spark):
    p = quality.quality_scores(table(spark, "documents", DATA)).join(table(spark, "labels", DATA), "doc_id").toPandas()
    kept = p.quality_score >= quality.THRESHOLD
    assert kept[p.quality == 1].mean() > 0.99 and kept[p.quality == 0].mean() < 0.4


def test_quality_of_long_texts(spark):
    docs, labels = table(spark, "documents", DATA), table(spark, "labels", DATA)
    long = docs.withColumn("text", F.expr("repeat(concat(text, ' '), cast(ceil(20500 / greatest(1, char_length(text))) as int))"))
    p = quality.quality_scores(long).join(labels, "doc_id").toPandas()
    kept = p.quality_score >= quality.THRESHOLD
    assert kept[p.quality == 1].mean() > kept[p.quality == 0].mean() + 0.3


def test_quality_of_odd_rows(odd, nothing):  # noqa: F811
    scored = quality.quality_scores(odd)
    assert scored.columns == [*odd.columns, "quality_score_"] and scored.count() == odd.count()
    assert quality.quality_filter(odd).columns == odd.columns
    assert quality.quality_filter(nothing).count() == 0


def test_products_of_a_fit_hold_a_bounded_part_of_its_rows():
    """Beside the rows a step holds what RUN entries need (before: several arrays as long as all entries, 48 MB here)."""
    import tracemalloc

    r = np.random.default_rng(3)
    sizes = [0, 0, 3 * hashing.Sparse.RUN, 0, 1, *r.integers(0, 3000, 400), 0]
    rows = [(r.integers(0, 500, n).astype("<i4"), r.random(n).astype("<f4")) for n in sizes]
    one, w, of_rows = hashing.Sparse(rows, 500), r.random(500), r.random(len(rows))
    np.testing.assert_allclose(one.dot(w), [(w[c] * v).sum() for c, v in rows], rtol=1e-9)
    np.testing.assert_allclose(one.sums(of_rows), sum(np.bincount(c, x * v, 500) for (c, v), x in zip(rows, of_rows)), rtol=1e-9)
    even = hashing.Sparse([(np.arange(1000, dtype="<i4") % 500, np.ones(1000, "<f4"))] * 6000, 500)
    tracemalloc.start()
    even.sums(even.dot(w))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 40 * hashing.Sparse.RUN
    assert hashing.Sparse([], 5).dot(np.ones(5)).shape == (0,) and hashing.Sparse([], 5).sums(np.zeros(0)).tolist() == [0.0] * 5
