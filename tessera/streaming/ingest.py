"""Incremental ingestion, for deployments that receive records as a stream.

The same deduplication as in batch: within the watermark a key is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, when: str, late: str = "1 hour") -> DataFrame:
    """Rows of keys not seen before; state is dropped behind the watermark."""
    timed = stream.withColumn(when, F.col(when).cast("timestamp"))
    return timed.withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def rolling_counts(stream: DataFrame, when: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) in tumbling windows."""
    timed = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return timed.groupBy(F.window(when, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
