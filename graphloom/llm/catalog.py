"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, clustering, embedding_dedup, mixing, packing, piece_codec, quality, simhash, substring_dedup, token_counts, token_files, toxicity, warc
from graphloom.llm.common import table, tokenizer_path

WORD_BPE, BYTE_BPE, PIECE_BPE, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model", 1


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE), 4096)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), least=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """The same mix; both bisections run in recursive queries."""
    seed, block, top = mixing.SEED, mixing.BLOCK_TOKENS, mixing.KEY_BITS // 4
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS src,
         md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY src),
q AS (SELECT tokens, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM s) AS p FROM s WHERE tokens > 0),
k AS (SELECT count(*) AS n, CAST(max(tokens) AS DOUBLE) AS most, CAST(max(tokens) AS DOUBLE) / min(tokens) AS spread FROM q),
h(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN e >= {mixing.ENTROPY} * ln(n) THEN mid ELSE low END, CASE WHEN e >= {mixing.ENTROPY} * ln(n) THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid, k.n,
               (SELECT ln(sum(pow(p, (low + high) / 2))) - sum(pow(p, (low + high) / 2) * (low + high) / 2 * ln(p)) / sum(pow(p, (low + high) / 2)) FROM q) AS e
        FROM h, k WHERE i < {mixing.HALVINGS})),
r(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(spread, (low + high) / 2) <= {mixing.REPEAT_LIMIT} THEN (low + high) / 2 ELSE low END,
         CASE WHEN pow(spread, (low + high) / 2) <= {mixing.REPEAT_LIMIT} THEN high ELSE (low + high) / 2 END
  FROM r, k WHERE i < {mixing.HALVINGS}),
natural_entropy AS (SELECT -sum(p * ln(p)) AS e FROM q),
t AS (
  SELECT CASE WHEN n < 2 THEN 1.0 ELSE greatest(
           CASE WHEN (SELECT e FROM natural_entropy) >= {mixing.ENTROPY} * ln(n) THEN 1.0 ELSE (SELECT low FROM h WHERE i = {mixing.HALVINGS}) END,
           1.0 - CASE WHEN spread <= {mixing.REPEAT_LIMIT} THEN 1.0 ELSE (SELECT low FROM r WHERE i = {mixing.HALVINGS}) END) END AS t FROM k),
g AS (SELECT src, tokens, CASE WHEN tokens > 0 THEN CAST(round_even(tokens * pow(most / tokens, 1 - t), 0) AS BIGINT) ELSE 0 END AS target FROM s, k, t),
f AS (SELECT *, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS full_, CASE WHEN tokens > 0 THEN target % tokens ELSE 0 END AS rest,
             (SELECT CAST(sum(target) AS BIGINT) FROM g) AS total FROM g),
e AS (
  SELECT doc_id, digest, f.*, n_tokens, epoch,
         CAST('0x' || substr(md5('{seed}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, {top}) AS BIGINT) AS key
  FROM d JOIN f USING (src), LATERAL (SELECT unnest(range(0, full_ + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch)),
c AS (
  SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS in_epoch,
         CAST(sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY key, doc_id, digest) AS BIGINT) AS end_ FROM e),
b AS (
  SELECT *, epoch * tokens + in_epoch AS before,
         CASE WHEN target > 0 THEN CAST(floor(CAST(epoch * tokens + in_epoch AS DOUBLE) / target * total / {block}) AS BIGINT)
              ELSE key % greatest(1, CAST(ceil(total / {block}) AS BIGINT)) END AS block_id
  FROM c WHERE epoch < full_ OR end_ <= rest)
SELECT doc_id, CASE WHEN src <> 'null' THEN substr(src, 2) END AS source, CAST(epoch AS BIGINT) AS epoch, n_tokens, CAST(before AS BIGINT) AS before, block_id,
       row_number() OVER (PARTITION BY block_id ORDER BY md5('{seed}-slot:' || epoch || coalesce(':' || CAST(doc_id AS VARCHAR), '') || ':' || digest), doc_id NULLS FIRST, epoch, src, before, n_tokens) AS slot
FROM b
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op10_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in quality.STOP_WORDS)
    bounds = []
    for r in quality.RULES:
        bounds += [f"{r.measure} >= {r.least}"] if r.least is not None else []
        bounds += [f"{r.measure} <= {r.most}"] if r.most is not None else []
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM g),
m AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(0, 5) AS r(k) GROUP BY doc_id),
x AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda s: lower(s) IN ({stop}))) AS n_stop_words,
         len(list_filter(w, lambda s: upper(s) = s AND lower(s) <> s)) AS n_shouted,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
y AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x),
z AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_stop_words / greatest(n_words, 1) AS stop_word_ratio,
         n_shouted / greatest(n_words, 1) AS shout_ratio FROM y)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM z
"""


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.cross_alignment(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.coded(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _op13_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds in a recursive query, every vector against every centroid."""
    nearest = """SELECT vec_id, x, min_by(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT q.vec_id, q.x, t.c, list_sum(list_transform(list_zip(q.x, t.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM q, {} t) GROUP BY vec_id, x"""
    return f"""
WITH RECURSIVE q AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}),
r(i, c, x) AS (
  SELECT 0, c, x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM q) WHERE c < {k}
  UNION ALL
  SELECT r.i + 1, r.c, coalesce(m.x, r.x) FROM r LEFT JOIN (
    SELECT c, list(v ORDER BY dim) AS x FROM (
      SELECT c, dim, CAST((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
      FROM (SELECT c, unnest(x) AS v, unnest(range({dims})) AS dim FROM ({nearest.format("r")})) GROUP BY c, dim) GROUP BY c) m ON m.c = r.c
  WHERE r.i < {rounds}),
f AS (SELECT c, x FROM r WHERE i = {rounds}),
a AS ({nearest.format("f")})
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a JOIN f ON f.c = a.c
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_cross_alignment": op11_cross_alignment,
    "op12_piece_codec": op12_piece_codec,
    "op13_clustering": op13_clustering,
}

ORACLE_SQL = {"op9_mixing": _op9_sql(), "op10_quality": _op10_sql(), "op13_clustering": _op13_sql()}
