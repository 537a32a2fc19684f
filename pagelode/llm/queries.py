"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, lexical, license, media, merkle, mixing, packing, pieces, pii, ppm, shingle_join, toxicity
from .storage import small_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(_documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingle_join.similarity_components(_documents(spark, sf_dir), width=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.in_training_order(mixing.mix_plan(_documents(spark, sf_dir)))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", (F.round("position", 9) + 0.0).alias("position"))


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no images; every vector of ``embeddings`` is shown as one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return media.image_groups(media.vector_images(vectors))


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_check(_documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ppm_scoring, op2_license_scan, op3_best_fit_packing, op4_language_id, op5_toxicity, op6_private_spans, op7_ngram_jaccard_join, op8_exact_dedup, op9_source_mixing, op10_media_copies, op11_sentencepiece_codec, op12_merkle_manifest, op13_lexical_search)
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license.oracle_sql(),
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
    "op8_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
""",
    "op9_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS most,
         CASE no % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, slope, least(most, coalesce((SELECT arg_min(level, (most / weight, no)) FROM l WHERE level < most / weight) * weight, most)) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start,
         CAST(floor(t.target + 0.5) AS BIGINT) AS want
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       greatest(0, least(size, want - start)) + greatest(0, least(size, want - start - source_size)) AS taken,
       round(CASE WHEN target > 0 AND want > start THEN
         CASE WHEN slope = 0 THEN least(1.0::DOUBLE, start / target)
              ELSE (sqrt(greatest(0.0::DOUBLE, (1 - slope) * (1 - slope) + 4 * slope * least(1.0::DOUBLE, start / target))) - (1 - slope)) / (2 * slope) END
       END, 9) + 0.0::DOUBLE AS position
FROM p
""",
}
