"""Filters over retrieved sets, reading a document, and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_metadata(found: DataFrame, docs: DataFrame, year_min: int | None = None, year_max: int | None = None, organisms: list[str] | None = None, mesh_terms: list[str] | None = None, publication_types: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of found whose document passes every filter that is set.

    A missing year fails both bounds; a bound of 0 or None is no bound.  An
    organism is sought as a part of abstract and title, terms and types match
    whole and without case.  Unknown ids act as empty documents.  Ranks stay.
    """
    if not (year_min or year_max or organisms or mesh_terms or publication_types):
        return found
    keep = F.lit(True)
    if year_min:
        keep &= F.coalesce("year", F.lit(0)) >= year_min
    if year_max:
        keep &= F.coalesce("year", F.lit(9999)) <= year_max
    if organisms:
        text = F.lower(F.concat(F.coalesce("abstract", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
        any_of = F.lit(False)
        for name in organisms:
            any_of |= F.contains(text, F.lit(name.lower()))
        keep &= any_of
    for column, wanted in (("mesh_terms", mesh_terms), ("publication_types", publication_types)):
        if wanted:
            low = F.array(*[F.lit(x.lower()) for x in wanted])
            keep &= F.coalesce(F.arrays_overlap(F.transform(column, F.lower), low), F.lit(False))
    # filters by known documents reach their scan; an unknown id fails any filter
    return found.join(docs.where(keep).select(key).distinct(), key, "left_semi")


def read_document(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunks, but the abstract, in order of position."""
    parts = chunks.where("section_type <> 'abstract'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "section_type", "section_heading", "text"))).alias("chunks"))
    return docs.join(parts, "doc_id", "left")


def confidence(ranked: DataFrame, queries: DataFrame, scale: float = 20.0, least: float = 0.3, gap: float = 2.0) -> DataFrame:
    """(query_id, confidence, gap, mean_top5, n, abstain) for every query.

    Confidence is the best score over scale, at most 1; the gap is from rank 1
    to rank 5, 0 with fewer.  It abstains below both limits and without results.
    """
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    got = ranked.groupBy("query_id").agg(at(1).alias("s1"), at(5).alias("s5"), F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("mean5"), F.count("*").alias("n"))
    sure = F.least(F.lit(1.0), F.col("s1") / scale)
    apart = F.when(F.col("s5").isNull(), F.lit(0.0)).otherwise(F.col("s1") - F.col("s5"))
    both = queries.select("query_id").distinct().join(got, "query_id", "left")
    return both.select("query_id", F.when(F.col("s1").isNull(), 0.0).otherwise(F.round(sure, 6)).alias("confidence"), F.coalesce(F.round(apart, 6), F.lit(0.0)).alias("gap"), F.coalesce(F.round("mean5", 6), F.lit(0.0)).alias("mean_top5"), F.coalesce("n", F.lit(0)).alias("n"), (F.col("s1").isNull() | ((sure < least) & (apart < gap))).alias("abstain"))


def hydrate(ranked: DataFrame, docs: DataFrame, title_chars: int = 200, text_chars: int = 300) -> DataFrame:
    """Results with their documents' attributes; unknown ones get defaults."""
    right = docs.select("doc_id", F.substring("title", 1, title_chars).alias("title"), "year", F.substring("text", 1, text_chars).alias("text"))
    out = ranked.join(right, "doc_id", "left")
    return out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


def prune(evidence: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    return evidence.join(dropped.select(key).distinct(), key, "left_anti")
