"""Ranking metrics over whole run tables, and their aggregates.

A run is (method, query_id, rank, doc_id); queries that returned nothing have a
row with a null document, so they stay in the denominators.  gold is (query_id,
doc_id), each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import store

CUTS = (5, 10, 20)


def from_lists(runs: DataFrame, docs: str = "retrieved_docs", query: str = "task_id") -> DataFrame:
    """Run rows with ordered lists as (.., query_id, rank, doc_id)."""
    rest = [c for c in runs.columns if c not in (docs, query)]
    return runs.select(*rest, F.col(query).alias("query_id"), F.posexplode_outer(docs).alias("rank", "doc_id")).withColumn("rank", F.coalesce(F.col("rank") + 1, F.lit(1)))


def per_query(run: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS, ndcg_at: int = 10) -> DataFrame:
    """(method, query_id, n_gold, recall_*, ndcg, mrr) for each of run's queries.

    No gold gives 0 everywhere.  A document listed twice counts once in recall
    and each time in the discounted gain.
    """
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = run.join(gold.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    at = lambda k: F.count_distinct(F.when((F.col("hit") == 1) & (F.col("rank") <= k), F.col("doc_id"))).alias(f"hits_{k}")
    gain = F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= ndcg_at), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    first = F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    got = marked.groupBy("method", "query_id").agg(*(at(k) for k in cuts), gain, first).join(sizes, "query_id", "left")
    n = F.coalesce("n_gold", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(ndcg_at)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    over = lambda x: F.when(n > 0, x).otherwise(0.0)
    return got.select("method", "query_id", n.alias("n_gold"), *(over(F.col(f"hits_{k}") / n).alias(f"recall_{k}") for k in cuts), over(F.col("dcg") / ideal).alias("ndcg"), over(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def aggregate(scores: DataFrame, queries: DataFrame, metrics: list[str], places: int = 4) -> DataFrame:
    """(method, family, metric, value, n): means of each method, over all
    (family 'all') and for each family, in one pass of grouping sets.

    Scores of unknown queries count in family 'unknown'.
    """
    both = scores.join(queries.select("query_id", "family"), "query_id", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    wide = both.groupingSets([["method"], ["method", "family"]], "method", "family").agg(*(F.round(F.avg(m), places).alias(m) for m in metrics), F.count("*").alias("n"), F.grouping("family").alias("g"))
    wide = wide.withColumn("family", F.when(F.col("g") == 1, "all").otherwise(F.col("family")))
    return wide.unpivot(["method", "family", "n"], metrics, "metric", "value")


def best_method(report: DataFrame, metric: str = "recall_10") -> DataFrame:
    return report.where((F.col("family") == "all") & (F.col("metric") == metric)).groupBy("metric").agg(F.max_by("method", F.struct("value", "method")).alias("method"), F.max("value").alias("value"))


def bootstrap(scores: DataFrame, a: str, b: str, metric: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(mean_difference, low, high, p, rounds): paired bootstrap of a minus b.

    Each round draws as many queries as there are, with replacement; draw i of
    round r is the query whose number is the first 32 bits of the MD5 of
    'seed:r:i', modulo their count.
    """
    wide = scores.where(F.col("method").isin(a, b)).groupBy("query_id").agg(F.max(F.when(F.col("method") == a, F.col(metric))).alias("x"), F.max(F.when(F.col("method") == b, F.col(metric))).alias("y")).where("x is not null and y is not null")
    one = Window.partitionBy(F.lit(0))  # one number a query
    d = store.written(wide.select((F.col("x") - F.col("y")).alias("d"), (F.row_number().over(one.orderBy("query_id")) - 1).cast("long").alias("at")))
    n = d.count()
    if not n:
        return d.select(F.col("d").alias("mean_difference"), *(F.col("d").alias(c) for c in ("low", "high", "p")), F.lit(rounds).alias("rounds"))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col("at").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = d.select("at").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).select("round", (bits % n).alias("at"))
    means = draws.join(d, "at").groupBy("round").agg(F.avg("d").alias("m"))
    observed = d.agg(F.round(F.avg("d"), 6).alias("mean_difference"))
    tail = lambda c: F.avg(c.cast("double"))
    ci = means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(F.least(F.lit(1.0), 2 * F.least(tail(F.round("m", 12) <= 0), tail(F.round("m", 12) >= 0))), 6).alias("p"))
    return observed.crossJoin(ci).withColumn("rounds", F.lit(rounds))


def near_miss(run: DataFrame, negatives: DataFrame) -> DataFrame:
    """(method, near_miss): share of retrieved documents that are negatives."""
    hit = run.where("doc_id is not null").join(negatives.select("query_id", "doc_id", F.lit(1).alias("neg")), ["query_id", "doc_id"], "left")
    return hit.groupBy("method").agg(F.round(F.avg(F.coalesce("neg", F.lit(0)).cast("double")), 6).alias("near_miss"))


def family_metrics(scores: DataFrame, queries: DataFrame, recall: str = "recall_20") -> DataFrame:
    """(method, family, coverage, complete, n): mean recall of each family's
    queries that have gold, and the share of them with all gold found."""
    both = scores.where("n_gold > 0").join(queries.select("query_id", "family"), "query_id")
    return both.groupBy("method", "family").agg(F.round(F.avg(recall), 6).alias("coverage"), F.round(F.avg((F.col(recall) >= 1).cast("double")), 6).alias("complete"), F.count("*").alias("n"))


def sides_covered(run: DataFrame, sides: DataFrame, k: int = 20) -> DataFrame:
    """(method, both_sides): share of queries with a hit on every side they have."""
    need = sides.groupBy("query_id").agg(F.count_distinct("side").alias("need"))
    hit = run.where(F.col("rank") <= k).join(sides, ["query_id", "doc_id"]).groupBy("method", "query_id").agg(F.count_distinct("side").alias("got"))
    all_ = run.select("method", "query_id").distinct().join(need, "query_id").join(hit, ["method", "query_id"], "left")
    return all_.groupBy("method").agg(F.round(F.avg((F.coalesce("got", F.lit(0)) == F.col("need")).cast("double")), 6).alias("both_sides"))


def passage_recall(found: DataFrame, gold: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, passage_recall): gold passages that a found one resembles.

    Resemblance is 1 - edit distance / longer length of (query_id, text).
    """
    g = gold.select("query_id", F.col("text").alias("want"), F.monotonically_increasing_id().alias("gid"))
    longest = F.greatest(F.length("want"), F.length("text"), F.lit(1))
    near = F.abs(F.length("want") - F.length("text")) <= (1 - least) * longest
    fit = near & (1 - F.levenshtein("want", "text") / longest >= least)
    marked = g.join(found.select("query_id", "text"), "query_id", "left").groupBy("query_id", "gid").agg(F.max(F.coalesce(fit, F.lit(False))).alias("hit"))
    return marked.groupBy("query_id").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("passage_recall"))


def workflow(trace: DataFrame) -> DataFrame:
    """(task_id, iterations, searches, duplicate_ratio) from rows of (task_id,
    round, action, doc_id)."""
    return trace.groupBy("task_id").agg(F.max("round").alias("iterations"), F.count_distinct(F.when(F.col("action") != "stop", F.col("round"))).alias("searches"), F.round(F.coalesce(1 - F.count_distinct("doc_id") / F.nullif(F.count("doc_id"), F.lit(0)), F.lit(0.0)), 6).alias("duplicate_ratio"))


def precision_recall(df: DataFrame, predicted: Column, label: Column) -> DataFrame:
    """(precision, recall, f1) of a 0/1 decision; 0 where undefined."""
    tp, p, y = F.sum(predicted * label), F.sum(predicted), F.sum(label)
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(F.round(zero(tp, p), 6).alias("precision"), F.round(zero(tp, y), 6).alias("recall"), F.round(zero(2 * tp, p + y), 6).alias("f1"))
