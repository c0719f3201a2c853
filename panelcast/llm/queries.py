"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe_automaton, exact_digest, langid, license_scan, packing, piece_counts, quality, simhash, suffix_dedup, url_templates
from panelcast.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = langid.trained(docs, hidden=8, steps=400)
    out = langid.predicted(docs.select("doc_id", "text"), network)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rated = quality.rated(docs)
    return quality.verdict(rated).select("doc_id", *quality.FIGURES, "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=200)


def op5_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


#: The rules of the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.token_ids(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.pack(tokens, window=4096)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, size=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_ALL = (op1_language_id, op2_bpe_automaton, op3_quality_rules, op4_suffix_dedup, op5_exact_digest, op6_license_scan, op7_url_templates, op8_packing, op9_token_counts, op10_simhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {}

SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
base AS (SELECT doc_id, source, words, len(words) AS n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, range(8) r(j) GROUP BY doc_id),
f AS (SELECT b.doc_id, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed FROM base b LEFT JOIN rep USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM f GROUP BY source),
s AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS h, sum(f * f / n) AS q, sum(n * n) AS n2 FROM h),
m AS (SELECT (f + 0.5) / (n + 1) AS m, n, h, n2,
  CASE WHEN h >= 2 AND n * n > n2 THEN ((q - f * f / n) / (h - 1) - greatest(f - q, 0) / greatest(n - h, 1)) / ((n - n2 / n) / (h - 1)) END AS v FROM s),
p AS (SELECT m, CASE WHEN h < 2 OR n * n <= n2 THEN 1 WHEN v <= 0 THEN 10000 ELSE least(greatest(m * (1 - m) / v - 1, 1), 10000) END AS k FROM m),
bad AS (SELECT source FROM h, p WHERE (h.f + p.m * p.k) / (h.n + p.k) > 0.5)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept FROM f
"""

SQL["op7_url_templates"] = url_templates.judge_sql(URL_RULES)

SQL["op6_license_scan"] = license_scan.scan_sql()
