"""Toxicity: a character n-gram linear classifier on naive Bayes scaled features.

Features say which hashed character n-grams the lower-cased text holds. Of all
buckets the ``FEATURES`` whose share of toxic texts differs most surely from that
of the others are used, each multiplied by its log-count ratio (of the smoothed
shares), and a ridged logistic regression is fitted on the products. The fit runs in one task on a bounded sample: up to
``SAMPLE_ROWS`` labelled rows of either class, those with the smallest hash of id,
whatever their length; the tasks that read them reduce each to its buckets, and the
fit gets those alone. Rows are weighted so that the classes count as in all labels. The model is 2 ** ``BITS`` numbers. Scoring reads
every whole text.

Defined cases: a null or empty text has no features and gets the score of the
bias; conflicting labels of an id count as toxic; without labelled rows of both
classes every score is the share of toxic labels (0 without any); repeated rows
are scored alike; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import byte_slices, plus_fields
from marketpulse.llm.hashing import Grams, Sparse, fit_logistic, lower_bytes, plus_column, sigmoid

SIZES, BITS, FEATURES = (4, 5, 6), 18, 512
SAMPLE_ROWS = 2000


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is never learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def scaled_features(x: Sparse, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each bucket, and which buckets are used."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    p, q = x.sums(y), x.sums(1 - y)
    sure = np.abs(p / n1 - q / n0) / np.sqrt((p / n1 + q / n0 + 1e-3) * (1 / n1 + 1 / n0))
    used = np.zeros(x.width, bool)
    used[np.argsort(-sure, kind="stable")[:FEATURES]] = True
    return np.log((p + 1) / (n1 + 2) / ((q + 1) / (n0 + 2))), used & (p + q > 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights per bucket and the bias, learnt from the labels of rows that are not held out."""
    known = (labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.col(label_col).cast("int")).alias("y")))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    plain = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(totals) < 2:
        return np.zeros(1 << BITS), plain
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = known.join(texts.select("id").distinct(), "id", "left_semi")
    picked = [ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for y in (0, 1)]
    key = F.xxhash64("id", F.coalesce("text", F.lit("")))
    sample = (texts.join(F.broadcast(picked[0].union(picked[1])), "id").select(key.alias("key"), "text", "y").dropDuplicates(["key"]))

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                rows = [b.astype("<i4").tobytes() for b, _ in Grams(lower_bytes(batch.column("text").to_pylist()), SIZES, BITS).rows()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(rows, pa.binary())], ["key", "y", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("key")
        y = rows.column("y").to_numpy().astype(float)
        if len(set(y)) < 2:
            yield pa.RecordBatch.from_pydict({"weights": [np.zeros(1 << BITS, "<f4").tobytes()], "bias": [plain]})
            return
        grams = [np.frombuffer(b, "<i4") for b in rows.column("buckets").to_pylist()]
        ratio, used = scaled_features(Sparse([(b, np.ones(len(b))) for b in grams], 1 << BITS), y)
        x = Sparse([(b[used[b]], ratio[b[used[b]]]) for b in grams], 1 << BITS)
        weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
        w, bias = fit_logistic(x, y, weight)
        yield pa.RecordBatch.from_pydict({"weights": [(w * ratio * used).astype("<f4").tobytes()], "bias": [bias]})

    reduced = sample.mapInArrow(reduce_texts, "key long, y int, buckets binary")
    model = reduced.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << BITS), plain
    return np.frombuffer(model["weights"], "<f4").astype(float), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in a further column."""
    weights, bias = model
    weights = weights.astype(np.float32)
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text, 1 << 20):
                grams = Grams(lower_bytes(batch.column(text).to_pylist()), SIZES, BITS)
                yield plus_column(batch, name, pa.array(sigmoid(grams.sums(weights) + bias)))

    return docs.mapInArrow(run, plus_fields(docs.schema, (name, "double")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    out = score(docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_")), model, "text" if id_col != "text" else "text_")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
