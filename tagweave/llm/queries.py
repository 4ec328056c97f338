"""The queries of this subpackage, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import ann, html_render, jaccard, mixing, packing, pii, quality, spotsigs, substrings, toxicity
from tagweave.llm.common import materialize, table

TOKENIZER = "byte_bpe_50k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = mixing.keyed(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(materialize(keyed.select("doc_id", "source", *mixing.KEYED), "keyed"))
    return mixed.select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + 8.0::DOUBLE * (length(text) - length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')))::DOUBLE / greatest(length(text), 1)::DOUBLE), 1.0::DOUBLE) AS weight
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) AS pos FROM sized GROUP BY source),
weighed AS (
  SELECT *, pos % 3 + 1 AS w, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (pos % 3 + 1)::DOUBLE AS ratio FROM ranked),
filled AS (
  SELECT *, (sum(source_size) OVER () ::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(w::DOUBLE * (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, pos LIMIT 1), cap::DOUBLE)) AS target FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goals),
ordered AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(u) / weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - prior)))::BIGINT AS taken FROM ordered
"""


def op2_render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.taking_part(table(spark, sf_dir, "embeddings"))
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.with_spans(docs.select("doc_id", "text"), pii.fit(docs))
    counts = [F.size(F.filter("_base", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("_spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spotsigs.with_next(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    docs = docs.withColumn("edited_signatures", spotsigs.signatures(F.col("edited")))
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.printed(F.col("signatures")).alias("fingerprint"),
        spotsigs.printed(F.col("edited_signatures")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_render_html": op2_render_html,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_substring_dedup": op10_substring_dedup,
}

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reached AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(b) FROM reached r WHERE r.a = w.doc_id), w.doc_id) AS component_id,
  coalesce((SELECT min(c.doc_id) FROM words c WHERE len(c.ws) > 0 AND c.doc_id IN (SELECT l.b FROM common l JOIN sizes z ON z.doc_id = l.b WHERE l.a = w.doc_id AND l.k = s.n AND z.n = s.n UNION ALL SELECT w.doc_id)), w.doc_id) AS class_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id
"""

OP10_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM words WHERE len(ws) >= 35)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE s IN (SELECT s FROM twice)),
each AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM words),
kept AS (
  SELECT e.doc_id, count(g.p) AS n_removed, string_agg(e.word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS rest
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op6_ngram_jaccard": OP6_SQL, "op10_substring_dedup": OP10_SQL}
