"""Quality classifier from weak labels.

``VOTES`` heuristics look at every document and vote good (1), bad (0) or abstain
(-1); they overlap and err. Vote patterns are counted over all documents, which
gives at most 3 ** len(VOTES) rows whatever the input, and expectation
maximisation on that table estimates the share of good documents and, for each
heuristic, how it votes on either class. The posterior of a pattern is the label
of its documents. A logistic scorer on hashed byte n-grams and three figures of
word repetition is fitted on soft labels of a bounded sample (``SAMPLE_ROWS`` from
either side, smallest hash first, of any length), and
scores every whole text. Sampled texts are reduced to their feature counts in
parallel tasks; the fit gets at most ``2 ** BITS`` counts of each. Labels of people are not used.

Defined cases: a null text counts as empty; all heuristics abstain on an empty
text, and its score is that of the bias; if the votes give only one class,
every document gets the score of that class; repeated rows are scored alike; an
empty table gives an empty result; columns of the input are carried unchanged
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import SPACES, byte_slices, free_name, plus_fields, text_or_empty, words_of
from marketpulse.llm.hashing import Grams, Sparse, fit_logistic, plus_column, sigmoid
from marketpulse.staging import stage

SIZES, BITS = (2, 3), 16
FIGURES = 3  # reserved buckets: shares of repeated neighbours, of repeated words, of repeated words two apart
SAMPLE_ROWS = 1500
ROUNDS, THRESHOLD = 200, 0.2

# Frequent short words of the corpus languages.
FREQUENT = ("the of and to in is that it for as with was on be by der die das und den von mit ist nicht ein eine "
            "le la les de des et un une en est que qui dans pour el los las y se del para con su").split()


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _vote(share: Column, good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, 0).otherwise(-1)


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row its key and the array of votes."""
    df = docs.select(text_or_empty(text_col).alias("text"), row_key(docs, text_col).alias("key"))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    low = F.regexp_replace("text", "[a-z]+", "")
    df = df.withColumn("rest", F.regexp_replace(low, SPACES + "+", ""))
    n = F.size("words")
    frequent = F.size(F.filter("words", lambda w: F.lower(w).isin(FREQUENT)))
    df = df.select("key", n.alias("n"), F.char_length("text").alias("chars"), F.size("lines").alias("n_lines"),
                   F.size(F.array_distinct("lines")).alias("n_distinct_lines"), F.size(F.array_distinct("words")).alias("n_distinct"),
                   frequent.alias("n_frequent"), F.char_length("rest").alias("n_rest"),
                   (F.char_length("rest") - F.char_length(F.regexp_replace("rest", r"[#*$%&|<>=@^~{}\\]+", ""))).alias("n_symbols"),
                   (F.char_length("rest") - F.char_length(F.regexp_replace("rest", "[A-Z]+", ""))).alias("n_upper"),
                   (F.char_length("rest") - F.char_length(F.regexp_replace("rest", "!+", ""))).alias("n_shouts"),
                   (F.char_length("rest") - F.char_length(F.regexp_replace("rest", r"\|+", ""))).alias("n_bars"))
    c = F.col
    symbols, upper, shouts, bars = (_share(c(x), c("chars")) for x in ("n_symbols", "n_upper", "n_shouts", "n_bars"))
    frequent, distinct, lines = _share(c("n_frequent"), c("n")), _share(c("n_distinct"), c("n")), _share(c("n_distinct_lines"), c("n_lines"))
    long = c("n") >= 20
    found = [
        _vote(symbols, symbols < 0.003, symbols > 0.02),
        _vote(upper, upper < 0.08, upper > 0.25),
        _vote(shouts, F.lit(False), shouts > 0.02),
        _vote(bars, F.lit(False), bars > 0.02),
        _vote(frequent, long & (frequent > 0.12), long & (frequent < 0.04)),
        _vote(distinct, long & (distinct > 0.4), long & (distinct < 0.2)),
        _vote(lines, (c("n_lines") > 2) & (lines > 0.9), (c("n_lines") > 2) & (lines < 0.6)),
        _vote(symbols, (c("n") > 0) & (c("chars") / c("n")).between(3.5, 9), (c("n") > 0) & ~(c("chars") / c("n")).between(3, 14)),
    ]
    return df.select("key", F.array(*(F.when(c("n") > 0, F.coalesce(v, F.lit(-1))).otherwise(-1).cast("int") for v in found)).alias("votes"))


VOTES = ("symbols", "capitals", "shouting", "bars", "frequent words", "distinct words", "distinct lines", "word length")


def row_key(docs: DataFrame, text_col: str) -> Column:
    """A hash that orders rows; equal rows share it."""
    return F.xxhash64(F.lit("quality"), text_or_empty(text_col))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good per pattern, the share of good, and P(vote | class) as [heuristic, class, vote].

    Starts from the majority of the votes; a heuristic's abstaining is information too.
    Counts get the prior of one document per cell that votes with its class.
    """
    given = patterns >= 0
    good = (0.7 + (patterns == 1).sum(1)) / (1.0 + given.sum(1))
    chance = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        for vote in (-1, 0, 1):
            chance[:, :, vote + 1] = ((patterns == vote).T.astype(float) @ weight.T) + 0.5
        chance[:, 0, 1] += 1
        chance[:, 1, 2] += 1
        chance /= chance.sum(2, keepdims=True)
        logs = np.log(chance)
        both = np.stack([np.log([1 - share, share][k]) + sum(logs[j, k, patterns[:, j] + 1] for j in range(patterns.shape[1])) for k in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(both[0] - both[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return good, share, chance


def repetition(texts: list[bytes]) -> np.ndarray:
    """Per text: share of words equal to the one before, to the one two before, and seen before."""
    out = np.zeros((len(texts), FIGURES))
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if n > 1:
            out[i] = (sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.__eq__, words, words[2:])) / n, 1 - len(set(words)) / n)
    return out


def _features(texts: list) -> tuple[Grams, np.ndarray]:
    data = [(t or "").encode() for t in texts]
    return Grams(data, SIZES, BITS), repetition(data)


#: Shares of n-grams are small numbers; this factor brings them near one.
GAIN = 100.0


def fit(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights (buckets, then figures) and bias of the scorer."""
    seen = stage(votes(docs, text_col), "quality-votes")
    table = seen.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(VOTES) rows
    width = (1 << BITS) + FIGURES
    if not table:
        return np.zeros(width), 0.0
    patterns, counts = np.array([r["votes"] for r in table]), np.array([r["n"] for r in table], float)
    good, _, _ = label_model(patterns, counts)
    if (good >= 0.5).all() or (good < 0.5).all():
        return np.zeros(width), 4.0 if good[0] >= 0.5 else -4.0
    labels = docs.sparkSession.createDataFrame([(r["votes"], float(g)) for r, g in zip(table, good)], "votes array<int>, good double")
    labelled = seen.join(F.broadcast(labels), "votes").select("key", "good").distinct()
    sides = [labelled.where(x).orderBy("key").limit(SAMPLE_ROWS) for x in ("good >= 0.5", "good < 0.5")]
    key = free_name(docs, "key")
    sample = (docs.select(text_or_empty(text_col).alias("text"), row_key(docs, text_col).alias(key))
              .join(F.broadcast(sides[0].union(sides[1]).withColumnRenamed("key", key)), key)
              .select(F.col(key).alias("key"), "text", "good").dropDuplicates(["key"]))
    bad_share = float((counts * (1 - good)).sum() / counts.sum())
    prior = float(np.log((1 - bad_share) / bad_share))  # the bias: what is said of a text without features

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                grams, figures = _features(batch.column("text").to_pylist())
                found = [(np.concatenate([b, (1 << BITS) + np.arange(FIGURES)]), np.concatenate([GAIN * v, 5 * f]))
                         for (b, v), f in zip(grams.rows(), figures)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("good"), pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary()),
                                                  pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["key", "good", "columns", "shares"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("key")
        y = rows.column("good").to_numpy()
        found = [(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")) for c, v in zip(rows.column("columns").to_pylist(), rows.column("shares").to_pylist())]
        side = y >= 0.5
        weight = np.where(side, (1 - bad_share) / max(1, side.sum()), bad_share / max(1, (~side).sum()))
        w, bias = fit_logistic(Sparse(found, width), y, weight, ridge=1e-5, fixed_bias=prior)
        w[:1 << BITS] *= GAIN
        w[1 << BITS:] *= 5
        yield pa.RecordBatch.from_pydict({"weights": [w.astype("<f4").tobytes()], "bias": [bias]})

    reduced = sample.mapInArrow(reduce_texts, "key long, good double, columns binary, shares binary")
    model = reduced.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return (np.zeros(width), 4.0) if model is None else (np.frombuffer(model["weights"], "<f4").astype(float), model["bias"])


def quality_scores(docs: DataFrame, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the chance that a document is good in a further column."""
    weights, bias = fit(docs, text_col)
    weights = weights.astype(np.float32)
    text, name = docs.columns.index(text_col), free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text, 1 << 20):
                grams, figures = _features(batch.column(text).to_pylist())
                scores = sigmoid(grams.means(weights[:1 << BITS]) + figures @ weights[1 << BITS:] + bias)
                yield plus_column(batch, name, pa.array(scores))

    return docs.mapInArrow(run, plus_fields(docs.schema, (name, "double")))


def quality_filter(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of ``threshold`` or more, with the columns of ``docs``."""
    name = free_name(docs, "quality_score")
    return quality_scores(docs, text_col, name).where(F.col(name) >= threshold).select(*docs.columns)
