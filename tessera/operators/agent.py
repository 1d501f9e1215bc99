"""Search agent: bounded rounds over all open tasks at once.

A policy turns open tasks with what they have seen into replies; the loop only
parses, searches and keeps books.  Each round is one batch of plans over the
table of open tasks, written before the next, so lineage doesn't grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import store
from tessera.functions import text as T
from tessera.operators import fusion, lexical

ROUNDS, RETRIEVED, SHOWN, SELECTED = 4, 15, 10, 20
_ACTION = "action string, query string, selected_docs array<string>"


def parsed(reply: Column | str) -> Column:
    """Action of a reply; anything that isn't a known one is a plain stop."""
    a = F.from_json(T.json_object(reply), _ACTION)
    kind = F.lower(a["action"])
    stop = F.struct(F.lit("stop").alias("action"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("array<string>").alias("selected_docs"))
    known = F.when(kind.isin("search", "refine") & (a["query"] != ""), F.struct(kind.alias("action"), a["query"].alias("query"), F.lit(None).cast("array<string>").alias("selected_docs")))
    return known.when(kind == "stop", F.struct(kind.alias("action"), F.lit(None).cast("string").alias("query"), a["selected_docs"].alias("selected_docs"))).otherwise(stop)


def observation(found: DataFrame, docs: DataFrame, shown: int = SHOWN, chars: int = 150) -> DataFrame:
    """(query_id, seen_text): the first results of a round as text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "doc_id", F.lit(": "), F.coalesce(F.substring("text", 1, chars), F.lit("")))
    lines = found.where(F.col("rank") <= shown).join(docs.select("doc_id", "text"), "doc_id", "left").select("query_id", F.struct("rank", line.alias("line")).alias("x"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("seen_text"))


def environment(index: lexical.Index, chunks: DataFrame, k: int = RETRIEVED, oversample: int = 3) -> Callable[[DataFrame], DataFrame]:
    """Search of (query_id, text): the first documents of each query."""

    def search(queries: DataFrame) -> DataFrame:
        ranked = lexical.search(index, queries, k * oversample).join(chunks.select("pos", "doc_id"), "pos")
        return fusion.first_per_document(ranked, k).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rank")

    return search


def run(tasks: DataFrame, policy: Callable[[DataFrame, int], DataFrame], search: Callable[[DataFrame], DataFrame], docs: DataFrame, rounds: int = ROUNDS, selected: int = SELECTED) -> tuple[DataFrame, DataFrame]:
    """((query_id, retrieved_docs, rounds, total_docs_seen), trace).

    tasks is (query_id, text); policy gets (query_id, text, seen_text, n_seen)
    and the round and gives (query_id, reply).  A stop without a list takes the
    first documents seen; a given list is trusted, capped.  docs is (doc_id
    string, text).  trace is (query_id, round, action, query, n_new).
    """
    state = store.written(tasks.select("query_id", "text", F.lit("").alias("seen_text"), F.lit(0).cast("long").alias("n_seen")))
    spark, kind = tasks.sparkSession, tasks.schema["query_id"].dataType.simpleString()
    seen = spark.createDataFrame([], f"query_id {kind}, doc_id string, round int, rank int")
    trace = spark.createDataFrame([], f"query_id {kind}, round int, action string, query string, selected_docs array<string>")
    open_ = state
    for r in range(1, rounds + 1):
        acts = store.written(policy(open_, r).select("query_id", parsed("reply").alias("a")).select("query_id", F.lit(r).alias("round"), "a.*"))
        trace = trace.unionByName(acts)
        going = acts.where("action <> 'stop'")
        if not going.take(1):
            break
        found = store.written(search(going.select("query_id", F.col("query").alias("text"))))
        seen = seen.unionByName(found.select("query_id", "doc_id", F.lit(r).alias("round"), "rank"))
        total = fusion.accumulated(seen).groupBy("query_id").agg(F.count("*").alias("n_seen"))
        still = open_.select("query_id", "text").join(going.select("query_id"), "query_id", "left_semi")
        shown = still.join(observation(found, docs), "query_id", "left").join(total, "query_id", "left")
        open_ = store.written(shown.select("query_id", "text", F.coalesce("seen_text", F.lit("")).alias("seen_text"), F.coalesce("n_seen", F.lit(0)).alias("n_seen")))
    first = fusion.accumulated(seen)
    lists = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "doc_id"))), lambda x: x["doc_id"]).alias("order"), F.count("*").alias("total_docs_seen"))
    said = trace.where("action = 'stop'").select("query_id", F.col("selected_docs").alias("said"))
    last = trace.groupBy("query_id").agg(F.max("round").alias("rounds"))
    out = tasks.select("query_id").join(lists, "query_id", "left").join(said, "query_id", "left").join(last, "query_id", "left")
    chosen = F.coalesce("said", "order", F.array().cast("array<string>"))
    return out.select("query_id", F.slice(chosen, 1, selected).alias("retrieved_docs"), F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("total_docs_seen", F.lit(0)).alias("total_docs_seen")), trace


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.round(F.avg("rounds"), 6).alias("mean_rounds"), F.round(F.avg("total_docs_seen"), 6).alias("mean_docs_seen"), F.count("*").alias("n"))


def fused_rollouts(rollouts: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """Rank fusion over (query_id, rollout, doc_id, rank) of several runs."""
    rollouts = rollouts.select("query_id", "doc_id", "rollout", "rank").repartition(store.parts(rollouts), "query_id")
    fused = rollouts.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("rollout", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")
