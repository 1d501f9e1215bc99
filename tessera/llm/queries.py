"""Queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, licences, near_dedup, neighbours, packing, quality, token_count, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_on(docs))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on(docs, _read(spark, sf_dir, "labels")))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(_read(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table has no paths: source/language/id stands for one."""
    path = F.concat_ws("/", "source", "lang", "doc_id")
    return licences.licences(_read(spark, sf_dir, "documents").withColumn("path", path))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, _read(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.score(_read(spark, sf_dir, "pages"), url_filter.fit(url_filter.labelled_urls()))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

# The statements of op9 and op10 hold fitted weights and the vocabulary, so they are
# made when they are asked for.
ORACLE_SQL: dict[str, Callable[[], str]] = {
    "op2_language_id": language.oracle_sql,
    "op7_license_scan": licences.oracle_sql,
    "op9_url_filter": url_filter.oracle_sql,
    "op10_token_counts": token_count.oracle_sql,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {name: made() for name, made in ORACLE_SQL.items()}
