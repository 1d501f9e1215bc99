"""Metrics of task families and of the search process.

A run is (method, query_id, rank, doc_id), as in ``metrics``; its first ``k``
documents count.  Each function gives one row a method, means over the queries
that its gold table has, 0 for a query that found nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, PLACES = 20, 6


def _found(run: DataFrame, k: int) -> DataFrame:
    return run.where((F.col("rank") <= k) & F.col("doc_id").isNotNull()).select("method", "query_id", "doc_id").distinct()


def _asked(run: DataFrame, gold: DataFrame) -> DataFrame:
    """(method, query_id, gold columns): what each method was asked for."""
    return run.select("method", "query_id").distinct().join(gold, "query_id")


def _mean(c: str):
    return F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), PLACES).alias(c)


def chains(run: DataFrame, links: DataFrame, k: int = K) -> DataFrame:
    """(method, link_recall, chain_completeness, n).

    links is (query_id, link, doc_id): a link is found with any of its documents,
    a chain is complete with all of its links.
    """
    need = links.groupBy("query_id").agg(F.count_distinct("link").alias("need"))
    got = _found(run, k).join(links, ["query_id", "doc_id"]).groupBy("method", "query_id").agg(F.count_distinct("link").alias("got"))
    each = _asked(run, need).join(got, ["method", "query_id"], "left").withColumn("link_recall", F.col("got") / F.col("need")).withColumn("chain_completeness", F.col("got") == F.col("need"))
    return each.groupBy("method").agg(_mean("link_recall"), _mean("chain_completeness"), F.count("*").alias("n"))


def bridging(run: DataFrame, bridges: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """(method, bridging_entity_found, n): the entity of bridges (query_id, entity)
    stands, whatever its case, in the text of a found document."""
    texts = _found(run, k).join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    hit = texts.join(bridges.where("entity <> ''"), "query_id").groupBy("method", "query_id", "entity").agg(F.max(F.contains("low", F.lower("entity"))).alias("bridging_entity_found"))
    each = _asked(run, bridges).join(hit, ["method", "query_id", "entity"], "left")
    return each.groupBy("method").agg(_mean("bridging_entity_found"), F.count("*").alias("n"))


def temporal(run: DataFrame, gold: DataFrame, years: DataFrame, era: int = 10, k: int = K) -> DataFrame:
    """(method, era_coverage, temporal_span_ratio, n).

    Eras are ``era`` years long; the share of the gold documents' eras that found
    documents are of.  The span is from the first year to the last; its ratio to
    the gold span is at most 1, and 1 where the gold has one year and that is met.
    """
    dated = years.where("year is not null").select("doc_id", "year", F.floor(F.col("year") / era).alias("era"))
    wanted = gold.join(dated, "doc_id")
    span = wanted.groupBy("query_id").agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.count_distinct("era").alias("eras"))
    held = _found(run, k).join(dated, "doc_id")
    met = held.join(wanted.select("query_id", "era").distinct(), ["query_id", "era"]).groupBy("method", "query_id").agg(F.count_distinct("era").alias("met"))
    own = held.groupBy("method", "query_id").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.collect_set("year").alias("all"))
    each = _asked(run, span).join(met, ["method", "query_id"], "left").join(own, ["method", "query_id"], "left")
    ratio = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), (F.col("last") - F.col("first")) / (F.col("hi") - F.col("lo")))).otherwise(F.array_contains("all", F.col("lo")).cast("double"))
    each = each.withColumn("era_coverage", F.col("met") / F.col("eras")).withColumn("temporal_span_ratio", ratio)
    return each.groupBy("method").agg(_mean("era_coverage"), _mean("temporal_span_ratio"), F.count("*").alias("n"))


def values(run: DataFrame, reported: DataFrame, k: int = K) -> DataFrame:
    """(method, value_completeness, complete_collection, source_coverage, n).

    reported is (query_id, value, doc_id): gold values and the papers that report
    them; a value is found with any of its papers.
    """
    need = reported.groupBy("query_id").agg(F.count_distinct("value").alias("values"), F.count_distinct("doc_id").alias("sources"))
    got = _found(run, k).join(reported, ["query_id", "doc_id"]).groupBy("method", "query_id").agg(F.count_distinct("value").alias("got"), F.count_distinct("doc_id").alias("papers"))
    each = _asked(run, need).join(got, ["method", "query_id"], "left")
    each = each.withColumn("value_completeness", F.col("got") / F.col("values")).withColumn("complete_collection", F.col("got") == F.col("values")).withColumn("source_coverage", F.col("papers") / F.col("sources"))
    return each.groupBy("method").agg(_mean("value_completeness"), _mean("complete_collection"), _mean("source_coverage"), F.count("*").alias("n"))


def negatives(run: DataFrame, gold: DataFrame, k: int = K) -> DataFrame:
    """(method, negative_precision, negative_recall, n): gold (query_id, doc_id) are
    the papers that truly report a negative finding."""
    need = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("need"))
    found = _found(run, k)
    size = found.groupBy("method", "query_id").agg(F.count("*").alias("size"))
    hit = found.join(gold.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("method", "query_id").agg(F.count("*").alias("hit"))
    each = _asked(run, need).join(size, ["method", "query_id"], "left").join(hit, ["method", "query_id"], "left")
    each = each.withColumn("negative_precision", F.col("hit") / F.col("size")).withColumn("negative_recall", F.col("hit") / F.col("need"))
    return each.groupBy("method").agg(_mean("negative_precision"), _mean("negative_recall"), F.count("*").alias("n"))


def constraint_coverage(run: DataFrame, constraints: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """(method, constraint_coverage, n): mean share of a query's constraints
    (query_id, value) that the text of some found document satisfies."""
    wanted = constraints.select("query_id", F.lower("value").alias("value")).where("value <> ''").distinct()
    texts = _found(run, k).join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    met = texts.join(wanted, "query_id").where(F.contains("low", "value")).groupBy("method", "query_id").agg(F.count_distinct("value").alias("met"))
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    each = _asked(run, need).join(met, ["method", "query_id"], "left").withColumn("constraint_coverage", F.col("met") / F.col("need"))
    return each.groupBy("method").agg(_mean("constraint_coverage"), F.count("*").alias("n"))


def tool_use(trace: DataFrame) -> DataFrame:
    """(task_id, filter_usage, citation_utility) from rows of (task_id, round,
    action, filtered, doc_id, final).

    Filter usage is the share of search rounds with a metadata filter; citation
    utility the share of the task's final documents that a citation expansion
    (action 'expand') found.
    """
    searched = F.when(F.col("action").isin("search", "refine"), F.col("round"))
    searches = trace.groupBy("task_id").agg(F.count_distinct(searched).alias("s"), F.count_distinct(F.when(F.col("filtered"), searched)).alias("f"))
    final = trace.where(F.col("final") & F.col("doc_id").isNotNull()).groupBy("task_id", "doc_id").agg(F.max(F.col("action") == "expand").alias("cited")).groupBy("task_id").agg(F.avg(F.col("cited").cast("double")).alias("u"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), PLACES)
    return searches.join(final, "task_id", "left").select("task_id", zero(F.col("f") / F.nullif(F.col("s"), F.lit(0))).alias("filter_usage"), zero(F.col("u")).alias("citation_utility"))
