"""Abstention: agreement features, calibration and a boosted classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import store
from tessera.operators.graph import dice

FEATURES = ["avg_pool_overlap", "bm25_n_retrieved", "n_constraints", "n_methods_agree_top1", "n_unique_top10", "query_length", "top1_agreement_rate"]


def jaccard(run: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, avg_pool_overlap): mean over pairs of methods that both
    returned something; 0 without such a pair."""
    sets = run.where((F.col("rank") <= depth) & F.col("doc_id").isNotNull()).groupBy("query_id", "method").agg(F.collect_set("doc_id").alias("s"))
    pairs = sets.alias("a").join(sets.alias("b"), (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.method") < F.col("b.method")))
    value = F.size(F.array_intersect("a.s", "b.s")) / F.size(F.array_union("a.s", "b.s"))
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.round(F.avg(value), 6).alias("avg_pool_overlap"))


def features(run: DataFrame, tasks: DataFrame, main: str = "bm25") -> DataFrame:
    """(query_id, FEATURES..., label) for each task with results.

    tasks has (query_id, text, n_constraints, family).
    """
    here = run.where("doc_id is not null")
    top1 = here.where("rank = 1").groupBy("query_id", "doc_id").count().groupBy("query_id").agg(F.max("count").alias("agree"), F.sum("count").alias("methods"))
    size = here.groupBy("query_id").agg(F.sum(F.when(F.col("method") == main, 1).otherwise(0)).alias("bm25_n_retrieved"), F.count_distinct(F.when(F.col("rank") <= 10, F.col("doc_id"))).alias("n_unique_top10"))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    base = tasks.join(run.select("query_id").distinct(), "query_id", "left_semi")
    out = base.join(size, "query_id", "left").join(top1, "query_id", "left").join(jaccard(run), "query_id", "left")
    zero = lambda c, x: F.coalesce(c, F.lit(0)).cast("double").alias(x)
    return out.select(
        "query_id", zero(F.col("avg_pool_overlap"), "avg_pool_overlap"), zero(F.col("bm25_n_retrieved"), "bm25_n_retrieved"), zero(F.col("n_constraints"), "n_constraints"),
        zero(F.col("agree"), "n_methods_agree_top1"), zero(F.col("n_unique_top10"), "n_unique_top10"), zero(words, "query_length"),
        zero(F.round(F.col("agree") / F.col("methods"), 6), "top1_agreement_rate"), (F.col("family") == "abstention").cast("int").alias("label"),
    )


_RANGES = 1024


def _cumulative(scored: DataFrame, score: str, label: str, upwards: bool) -> DataFrame:
    """(s, p, n, upto_p, upto_n): counts of each distinct score and of all up to
    it, in order.  Scores are cut into ranges of equal width that are summed one
    by one, so only the totals of the ranges pass through a single window."""
    by = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(label).alias("p"), F.count("*").alias("n")).where("s is not null")
    ends = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # one row
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    by = by.crossJoin(ends).select("s", "p", "n", F.coalesce(F.floor((F.col("s") - F.col("lo")) / width * _RANGES), F.lit(0)).alias("r"))
    order = (lambda c: F.asc(c)) if upwards else (lambda c: F.desc(c))
    before = Window.orderBy(order("r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = by.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn")).select("r", F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"))
    within = Window.partitionBy("r").orderBy(order("s")).rowsBetween(Window.unboundedPreceding, 0)
    inner = by.select("r", "s", "p", "n", F.sum("p").over(within).alias("wp"), F.sum("n").over(within).alias("wn"))
    return inner.join(ranges, "r").select("s", "p", "n", (F.col("bp") + F.col("wp")).alias("upto_p"), (F.col("bn") + F.col("wn")).alias("upto_n"))


def auroc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(auroc) by rank sums of the distinct scores; ties share their mean rank."""
    cum = _cumulative(scored, score, label, True)
    total = cum.agg(F.sum(F.col("p") * (F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return total.select(F.when((F.col("p") > 0) & (neg > 0), F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg), 6)).alias("auroc"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(average_precision): precision at each distinct score times recall gained."""
    cum = _cumulative(scored, score, label, False)
    return cum.agg(F.round(F.sum(F.col("p") * F.col("upto_p") / F.col("upto_n")) / F.nullif(F.sum("p"), F.lit(0)), 6).alias("average_precision"))


def risk_coverage(scored: DataFrame, steps: int = 100, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, coverage, risk): answered where the score is below it.

    Rows are first counted for each step that they fall under, so the sweep
    works on steps + 2 sums.
    """
    least = F.floor(F.col(score) * steps) + 1  # first step whose threshold is above
    # products round either way, so the neighbours are compared exactly
    exact = F.when(F.col(score) < (least - 1) / steps, least - 1).when(F.col(score) < least / steps, least).otherwise(least + 1)
    by = scored.select(F.greatest(F.lit(0), F.least(exact, F.lit(steps + 1))).cast("int").alias("step"), F.col(label).alias("y")).groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    grid = scored.sparkSession.range(steps + 2).select(F.col("id").cast("int").alias("step")).join(by, "step", "left")
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    cum = grid.select("step", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"), F.coalesce(F.sum("y").over(upto), F.lit(0)).alias("y"), F.sum("n").over(whole).alias("all"))
    return cum.where(F.col("step") <= steps).select((F.col("step") / steps).alias("threshold"), F.round(F.col("n") / F.col("all"), 6).alias("coverage"), F.round(F.when(F.col("n") > 0, F.col("y") / F.col("n")).otherwise(0.0), 6).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """(aurc): absolute trapezoid area of risk over coverage."""
    order = Window.orderBy("threshold")
    d = curve.select(((F.col("coverage") - F.lag("coverage").over(order)) * (F.col("risk") + F.lag("risk").over(order)) / 2).alias("d"))
    return d.agg(F.round(F.abs(F.sum("d")), 6).alias("aurc"))


def folds(data: DataFrame, k: int = 5, key: str = "query_id", label: str = "label") -> DataFrame:
    """data with ``fold``: stratified, seeded, at most as many as the rarer label."""
    w = Window.partitionBy(label)
    counts = data.groupBy(label).count().agg(F.min("count").alias("m"), F.count("*").alias("kinds")).first()
    k = max(1, min(k, counts["m"] or 1)) if counts["kinds"] == 2 else 1
    return data.withColumn("fold", (F.row_number().over(w.orderBy(dice(key), key)) - 1) % k)


def _classifier(trees: int, depth: int, rate: float, least: int, seed: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least, seed=seed)


def _assembled(data: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data)


def out_of_fold(data: DataFrame, k: int = 5, trees: int = 100, depth: int = 3, rate: float = 0.1, least: int = 5, seed: int = 42) -> DataFrame:
    """(query_id, label, score): each row scored by a fit on the other folds.

    Each fold's fit is a distributed job of its own.
    """
    from pyspark.ml.functions import vector_to_array

    parts = _assembled(store.written(folds(data, k)))
    gbt, out = _classifier(trees, depth, rate, least, seed), None
    for f in sorted(r["fold"] for r in parts.select("fold").distinct().collect()):
        train = parts.where(F.col("fold") != f)
        if not train.take(1):
            train = parts
        one = gbt.fit(train).transform(parts.where(F.col("fold") == f)).select("query_id", "label", vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def importances(data: DataFrame, trees: int = 100, depth: int = 3, rate: float = 0.1, least: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, rank) from a fit on all rows; they sum to 1."""
    every = _classifier(trees, depth, rate, least, seed).fit(_assembled(store.written(data))).featureImportances.toArray().tolist()
    rows = sorted(zip(FEATURES, every), key=lambda x: -x[1])
    return data.sparkSession.createDataFrame([(f, float(x), i + 1) for i, (f, x) in enumerate(rows)], "feature string, importance double, rank int")


def cross_validated(data: DataFrame, k: int = 5, **parameters) -> tuple[DataFrame, dict[str, float]]:
    """(out-of-fold scores, importance by feature, largest first)."""
    weights = importances(data, **parameters)
    return out_of_fold(data, k, **parameters), {r["feature"]: r["importance"] for r in weights.orderBy("rank").collect()}
