"""Queries of this package and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemforge.llm import decontamination, jaccard_join, kd_sharding, language_id, license_scan, merkle_manifest, oracles, piece_sampling, pitman_yor, sentence_spans, simhash, toxicity, url_filters, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard_documents(_docs(spark, sf_dir), shards=8)


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.digest(_docs(spark, sf_dir), piece_sampling.load_vocabulary())


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_docs(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_docs(spark, sf_dir))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.digest(_docs(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_docs(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_docs(spark, sf_dir))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filters.default_rules())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_sharding": op1_kd_sharding,
        "op2_piece_sampling": op2_piece_sampling,
        "op3_pitman_yor": op3_pitman_yor,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_license_scan": op7_license_scan,
        "op8_simhash": op8_simhash,
        "op9_sentence_spans": op9_sentence_spans,
        "op10_decontamination": op10_decontamination,
        "op11_whitening": op11_whitening,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_url_filters": op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": oracles.merkle_manifest(), "op13_url_filters": oracles.URL_FILTERS}
