"""The queries opN_* with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.llm import divergence, exact, lines, mixing, neardup, packing, phrases, quality, runs, sharding, substrings, toxicity, warc
from marketpulse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register(fn) if fn else register


@query(sql=r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT)
    >> (15 - 5 * (i % 4))) & 31 AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""")
def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(sql=r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, sha AS text_sha256
FROM n WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query(sql=r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source) AS k,
    coalesce(sum(3 * n) OVER before, 0) AS gone, coalesce(sum(w) OVER before, 0) AS gone_w, sum(n) OVER () AS t, sum(w) OVER () AS tw
  FROM s WINDOW before AS (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS k FROM o WHERE 3 * n * (tw - gone_w) >= (t - gone) * w),
g AS (SELECT source, n, CASE WHEN o.k < f.k THEN 3 * n ELSE (SELECT t - gone FROM o, f WHERE o.k = f.k) * w END AS a,
    CASE WHEN o.k < f.k THEN 1 ELSE (SELECT tw - gone_w FROM o, f WHERE o.k = f.k) END AS b FROM o, f),
q AS (SELECT source, n, CAST(a AS DOUBLE) / b AS target, least(a // b, 3 * n) AS takes FROM g),
c AS (SELECT d.*, q.n, q.target, takes // greatest(q.n, 1) AS passes, takes % greatest(q.n, 1) AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key) - size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(size * (passes + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (mixing.mixed(docs, F.array("source"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


@query
def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (divergence.distribution_rules(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= quality.THRESHOLD).alias("kept"))


@query(sql=r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)),
    lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM w),
c AS (SELECT doc_id, g, len(g) AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS id FROM g),
s AS (SELECT id, n, unnest(g) AS s FROM c WHERE doc_id = id),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT DISTINCT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM c JOIN m USING (id)""")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query(sql=r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
o AS (SELECT doc_id, h, n, unnest(range(0, n - 99, 256)) AS o FROM d WHERE n >= 100),
s AS (SELECT doc_id, o, substr(h, 2 * o + 1, 710) AS s, unnest(range(least(256, n - 99 - o))) AS j FROM o),
g AS (SELECT doc_id, o + j AS i, md5(substr(s, 2 * j + 1, 200)) AS g FROM s),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
b AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w + 100, -1) AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM x GROUP BY doc_id, run),
t AS (SELECT r.*, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (SELECT t.doc_id, count(*) AS spans, sum(z - a) AS gone, max(z) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


@query
def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


@query(sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
f AS (SELECT list(c ORDER BY b) AS f FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(b))),
o AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(before * 8 // total AS INT) AS shard, hex(encode(t)) AS h FROM o)
SELECT doc_id, size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(f[1 + (xor(c, b) & 255)], c >> 8))) AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM s, f""")
def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(runs.with_loops(table(spark, sf_dir, "documents")))
    best = F.col("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(sql=r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, greatest(1, len(w) - m + 2)), lambda i: w[i:i + m - 1])) AS g FROM w, range(1, 5) r(m)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, g, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
u AS (SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: g[i:i + j - 1])))) AS g FROM f WHERE m > 2),
i AS (SELECT lang, g, max(f) AS longer FROM u GROUP BY lang, g),
o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE coalesce(100 * longer < 80 * a, true))
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM o JOIN t ON t.lang = o.lang QUALIFY rank <= 2000""")
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))
