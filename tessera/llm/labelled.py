"""Bounded labelled samples for the classifiers that are fitted here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """((__id, __text, __y) of the sample, labels of each kind in the whole table).

    Of each class the ``most`` ids whose hash is least are taken, so the sample
    is bounded, and the same in every run.  A label that is null, neither 0 nor
    1, or contradicted by another row of its id is ignored, as is one whose
    document is absent or has a null text.  Of documents that share an id the
    least text counts.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y"))
        .where("__id is not null and __y in (0, 1)")
        .groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z")
    )
    totals = {int(r["__y"]): int(r["count"]) for r in one.groupBy("__y").count().collect()}
    order = [F.xxhash64(F.col("__id")), F.col("__id")]
    chosen = one.where("__y = 0").orderBy(*order).limit(most).union(one.where("__y = 1").orderBy(*order).limit(most)).select("__id", "__y")
    # at most 2 * most ids: small enough to send everywhere, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(chosen), "__id").where("__text is not null")
    return rows.groupBy("__id").agg(F.min("__text").alias("__text"), F.min("__y").alias("__y")), totals
