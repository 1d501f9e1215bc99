"""The registry of queries and of their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(statement: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def take(fn):
        QUERIES[fn.__name__] = lambda spark, d: whole_numbers(fn(spark, d))
        if statement:
            ORACLE_SQL[fn.__name__] = statement
        return fn

    return take


def whole_numbers(df: DataFrame) -> DataFrame:
    """Whole numbers as 64 bits, as the statements give them."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
