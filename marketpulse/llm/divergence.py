"""Quality rules by distribution divergence, DataFrame operations only.

Every document is reduced to counts in one pass, inside its row: words, repeated
word windows, repeated lines, characters per class and common words of its
language. The reference of a language is the sum of those counts over all its
documents that pass the base rules and are long enough, so it is exact, grows
with the corpus and has one row per listed language (others share a row). A
document is dropped if the Jensen-Shannon distance (base 2, 0 to 1) between its
histogram and the reference is above a limit; documents shorter than a guard are
not judged by that histogram.

Defined cases: null text counts as empty; a document without words fails the base
rules; languages without a word list, null among them, are judged by character
classes against one joint reference; repeated rows are judged alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import SPACES, text_or_empty, words_of
from marketpulse.staging import stage

# Character classes, counted in this order; what is left is the last class.
CLASSES = (
    ("lower", "[a-z]"),
    ("space", SPACES),
    ("symbol", r"[#*$%&|<>]"),
    ("upper", "[A-Z]"),
    ("letter", r"\p{L}"),
    ("digit", "[0-9]"),
    ("mark", r"[.,;:?!'\"()\-]"),
)
# Common words of each language.
COMMON = {
    "en": "the of and to in is that it for as with was on be by this are or an from".split(),
    "de": "der die das und in zu den von mit ist im nicht ein eine auf dem des sich für als".split(),
    "fr": "le la les de des et un une en à est que qui dans pour du par sur au avec".split(),
    "es": "el la los las de y en que un una por con para del se es al su como lo".split(),
}
MIN_CHARS, MOST_CHAR_DISTANCE = 200, 0.20
MIN_WORDS, MOST_WORD_DISTANCE = 100, 0.32
WINDOW = 5


def _repeated_windows(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows of five found twice or more.

    A text whose window hashes are all different needs no more work; else the
    hashes are sorted with their places, and the union of the repeated windows is
    measured from one start to the next.
    """
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *(F.get("words", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("grams", grams)
    placed = F.when(F.size(F.array_distinct("grams")) < F.size("grams"),
                    F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("placed", placed)
    starts = F.array_sort(F.transform(F.filter("placed", lambda x, i: (x["h"] == F.get("placed", i + 1)["h"])
                                               | (x["h"] == F.when(i > 0, F.get("placed", i - 1)["h"]))), lambda x: x["i"]))
    df = df.withColumn("starts", starts)
    runs = F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("grams", "placed", "starts")


def _common_words(text: Column, lang: Column) -> Column:
    """Counts of the common words of the text's language, then of all other words."""
    every = sorted({w for words in COMMON.values() for w in words})
    tokens = F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")
    hits = F.concat(F.lit(" "), F.array_join(F.filter(tokens, lambda w: w.isin(every)), "  "), F.lit(" "))
    wanted = reduce(lambda c, kv: c.when(lang == kv[0], F.array(*map(F.lit, kv[1]))), list(COMMON.items())[1:],
                    F.when(lang == next(iter(COMMON)), F.array(*map(F.lit, next(iter(COMMON.values()))))))
    return F.struct(hits.alias("hits"), F.size(tokens).alias("n"), F.coalesce(wanted, F.array().cast("array<string>")).alias("wanted"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, language, the counts of the base rules and the two histograms."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                     F.when(F.col(lang_col).isin(list(COMMON)), F.col(lang_col)).otherwise("other").alias("lang"))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = _repeated_windows(df.withColumn("lines", lines)).withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("words", "lines")
    left = F.col("text")
    lengths = [F.char_length("text").alias("len0")]
    for i, (_, pattern) in enumerate(CLASSES):
        left = F.regexp_replace(left, f"{pattern}+", "")
        lengths.append(F.char_length(left).alias(f"len{i + 1}"))
    df = df.select("id", "lang", "n_words", "n_dup_lines", "n_repeat_words", *lengths, _common_words(F.col("text"), F.col("lang")).alias("common"))
    chars = [F.col(f"len{i}") - F.col(f"len{i + 1}") for i in range(len(CLASSES))]
    counts = F.transform("common.wanted", lambda w: F.call_function("div", F.length("common.hits") - F.length(
        F.replace(F.col("common.hits"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))), F.length(w) + 2))
    df = df.select("id", "lang", "n_words", (F.col("len0") - chars[1]).cast("long").alias("word_chars"), chars[2].cast("long").alias("n_symbols"),
                   "n_dup_lines", "n_repeat_words", F.array(*chars, F.col(f"len{len(CLASSES)}")).cast("array<long>").alias("chars"),
                   counts.alias("common_counts"), F.col("common.n").alias("n_tokens"))
    rest = F.col("n_tokens") - F.aggregate("common_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*df.columns[:-2], F.concat("common_counts", F.array(rest)).alias("tokens"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if either is empty."""
    def total(x):
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v).cast("double")

    shares = F.zip_with(F.transform(p, lambda v: v / total(p)), F.transform(q, lambda v: v / total(q)),
                        lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    jsd = F.aggregate(shares, F.lit(0.0), lambda a, v: a + v) / 2
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(jsd, F.lit(0.0)))).otherwise(0.0)


def language_references(counts: DataFrame) -> DataFrame:
    """Summed histograms per language: one row for each listed language and one for the others."""
    width = {"chars": len(CLASSES) + 1, "tokens": max(map(len, COMMON.values())) + 1}
    good = counts.where(~base_failed() & (F.col("n_words") >= MIN_WORDS))
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in width.items() for i in range(n)]
    return good.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"),
        *(F.filter(F.array(*(f"{c}{i}" for i in range(n))), lambda v: v.isNotNull()).alias(f"ref_{c}") for c, n in width.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distribution_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, the counts, base_failed, char_distance, word_distance and kept."""
    counts = stage(document_counts(docs, id_col, text_col, lang_col), "rule-counts")
    refs = language_references(counts)
    judged = counts.join(F.broadcast(refs), F.col("lang") == F.col("ref_lang"), "left")
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, v: a + v)
    n_tokens = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, v: a + v)
    far = F.when((n_chars >= MIN_CHARS) & F.col("ref_chars").isNotNull(), _distance(F.col("chars"), F.col("ref_chars")))
    off = F.when((n_tokens >= MIN_WORDS) & F.col("ref_tokens").isNotNull(), _distance(F.col("tokens"), F.col("ref_tokens")))
    out = judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), far.alias("char_distance"), off.alias("word_distance"))
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & fine)
