"""Registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilframe import session
from vigilframe.llm import decontaminate, fingerprints, language, mixing, periodic, prefix_trie, quality, shards, simhash, vectors, warc
from vigilframe.llm.common import id_fold, table
from vigilframe.llm.token_counts import token_counts
from vigilframe.llm.token_output import token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Labels of rows in fold 0 are never learned from; documents that score less are rejected.
QUALITY_FOLDS, QUALITY_LEAST = 5, 0.3


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@register
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


@register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@register
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = f"{session.checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    placed = shards.shard_table(table(spark, sf_dir, "documents"), 16, maps)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@register
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, id_fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(id_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return language.languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(table(spark, sf_dir, "documents"))
    plan = mixing.plan_mix(rows, mixing.source_rates(rows, weights=(5, 2, 1), share=1.5, most=2.0))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE["op5_mixing"] = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS digest FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0 * source_size AS cap FROM totals
), levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio FROM weighed
), filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap::DOUBLE) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM levels
), settled AS (
  SELECT *, min(CASE WHEN level <= ratio THEN level END) OVER () AS least_level,
    first(level) OVER (ORDER BY CASE WHEN level <= ratio THEN 0 ELSE 1 END, ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS found,
    bool_or(level <= ratio) OVER () AS any_found FROM filled
), rates AS (
  SELECT source, source_size, CASE WHEN any_found THEN least(cap::DOUBLE, weight * found) ELSE cap::DOUBLE END AS target FROM settled
), rated AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS drawn
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""


@register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, quality.learning_labels(labels, id_fold(F.col("doc_id"), QUALITY_FOLDS) != 0))
    scored = quality.quality_scores(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(id_fold(F.col("doc_id"), QUALITY_FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@register
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{session.checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.archived_pages(spark, folder)


ORACLE["op9_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM payloads
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM hashed
"""


@register
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE["op11_prefix_trie"] = """
WITH said AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), said) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM said
), drawn AS (
  SELECT conv_id, conv_id - conv_id % 100 AS giver, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, len(name) + 1), lambda i: ascii(name[i])::BIGINT)),
      lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: xor(a >> 1, (a & 1) * 3988292384::BIGINT))
    ), 4294967295::BIGINT) % 6 AS h
  FROM convs
), rebuilt AS (
  SELECT d.conv_id, s.said, s.chars, 0 AS part, s.place FROM drawn d JOIN said s ON s.conv_id = d.giver AND s.place < d.h
  UNION ALL
  SELECT d.conv_id, s.said, s.chars, 1, s.place FROM drawn d JOIN said s ON s.conv_id = d.conv_id AND s.place >= d.h
), placed AS (
  SELECT conv_id, said, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM rebuilt
), prefixes AS (
  SELECT conv_id, depth, chars, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM placed
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), members AS (
  SELECT *, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS above, max(depth) OVER (PARTITION BY conv_id) AS turns FROM prefixes
), nodes AS (
  SELECT prefix, depth, any_value(above) AS above, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256
  FROM members GROUP BY prefix, depth
), children AS (
  SELECT above, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.prefix = c.above
), sums AS (
  SELECT m.prefix, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM counted n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON n.prefix = s.prefix LEFT JOIN nodes p ON n.above = p.prefix
"""


@register
def op12_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_copies(table(spark, sf_dir, "embeddings"), least=0.98)


ORACLE["op12_vector_copies"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS one, b.vec_id AS other FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT one, other FROM links
  UNION
  SELECT r.one, l.other FROM reached r JOIN links l ON r.other = l.one
), counted AS (
  SELECT one, count(*) AS n_links FROM links GROUP BY one
), least AS (
  SELECT one, min(other) AS other FROM reached GROUP BY one
)
SELECT e.vec_id, coalesce(c.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.one LEFT JOIN least l ON e.vec_id = l.one
"""


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.repeated_from).drop("n_words")
