"""Corpus pipeline: toxicity, quality, near duplicates, contamination, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that
its predecessor kept.  ``run`` writes each result as Parquet to the shared
folder and reads it back as the next stage's input.

Rows with a null ``doc_id`` pass the stages that decide by id; a null text is
scored as an empty one.  An empty table gives an empty result.

Whole texts go to Python in every stage.  Spark's batches of 64 MB lie in the JVM and
in the worker at once, and neither gives back what it grew to, so the stages of one
session add up; each stage sets batches of ``BATCH_BYTES``, which changes no result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near_dedup, packing, quality, scratch, toxicity

BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_small_batches(stage: Callable) -> Callable:
    """The stage with the session set to small Arrow batches, also for the plan it returns."""

    @wraps(stage)
    def set_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return set_first


@_in_small_batches
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


@_in_small_batches
def low_quality_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.reject(docs, model)


@_in_small_batches
def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@_in_small_batches
def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("quality classifier", low_quality_out),
    ("near duplicates", near_copies_out),
    ("benchmark decontamination", benchmark_out),
    ("best-fit packing", packed),
]

# The stages fit models, align texts and pack greedily, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    set_before = spark.conf.get(_SETTING)
    try:
        for _, stage in STAGES:
            before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
            scratch.drop(before)  # only the written result is read from here on
    finally:
        spark.conf.set(_SETTING, set_before)
    return docs
