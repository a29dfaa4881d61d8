"""The queries of the text operators: name to function of (spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import centroids, html_template, imatch, jaccard_join, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, repeated_passages, resampling, toxicity
from saltmarsh.llm.common import cut, table


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_fingerprint_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op3_jaccard_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_quality_rules_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op7_quality_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents")).select("doc_id", "posterior", "score", "kept")


def op8_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(mixing.with_sizes(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "_tie"))
    return mixing.mix(slim).select("doc_id", "size", "source_size", "target", "taken")


def op11_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeated_passages.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_resample_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii_skip_chain": op1_pii_skip_chain,
    "op2_fingerprint_imatch": op2_fingerprint_imatch,
    "op3_jaccard_lsh_forest": op3_jaccard_lsh_forest,
    "op4_quality_rules_gbt": op4_quality_rules_gbt,
    "op5_pack_nnls": op5_pack_nnls,
    "op6_html_template": op6_html_template,
    "op7_quality_weak_labels": op7_quality_weak_labels,
    "op8_toxicity_noisy_channel": op8_toxicity_noisy_channel,
    "op9_line_dedup_simhash": op9_line_dedup_simhash,
    "op10_mix_sources": op10_mix_sources,
    "op11_substring_automata": op11_substring_automata,
    "op12_resample_radix": op12_resample_radix,
    "op13_centroids_gemm": op13_centroids_gemm,
}

ORACLES = {
    "op10_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((rank - 1) % 3 AS INT) + 1] AS weight, 3 * source_size AS cap FROM sources),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN cap / weight <= share THEN CAST(cap AS DOUBLE)
              ELSE weight * max(CASE WHEN cap / weight > share THEN share END) OVER () END AS target
  FROM shares),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * size
            + least(greatest(budget - CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * source_size - before, 0), size) AS BIGINT) AS taken
FROM placed
""",
    "op11_substring_automata": repeated_passages.SQL,
    "op12_resample_radix": resampling.SQL,
    "op13_centroids_gemm": centroids.SQL,
}
