"""Lists of results: document deduplication, rank fusion, reranking, pooling."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_document(ranked: DataFrame, k: int, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Best chunk of each document, ranked anew, the first k."""
    one = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(query, doc).orderBy("rank"))).where("__n = 1").drop("__n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).where(F.col("rank") <= k)


def reciprocal_rank(lists: list[DataFrame], item: str, k: int, constant: int = 60, query: str = "query_id") -> DataFrame:
    """(query, item, score, rank): sum of 1 / (constant + rank) over the lists.

    Equal scores keep the order of first appearance: an earlier list first,
    then the better rank in it.  One shuffle on (query, item).
    """
    every = None
    for i, one in enumerate(lists):
        part = one.select(query, item, "rank", F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(query, item).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "first", item)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def hybrid_chunks(lists: list[DataFrame], chunks: DataFrame, k: int, oversample: int = 5, constant: int = 60) -> DataFrame:
    """Fusion of chunk lists, then deduplication to documents."""
    fused = reciprocal_rank(lists, "pos", k * oversample, constant)
    return first_per_document(fused.join(chunks.select("pos", "doc_id"), "pos"), k)


def hybrid_documents(lists: list[DataFrame], k: int, oversample: int = 3, constant: int = 60) -> DataFrame:
    """Deduplication of each list to documents, then fusion."""
    return reciprocal_rank([first_per_document(x, k * oversample) for x in lists], "doc_id", k, constant)


def rerank(ranked: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], depth: int = 50, chars: int = 400) -> DataFrame:
    """The first ``depth`` results ordered by an injected pair scorer."""
    pairs = ranked.where(F.col("rank") <= depth).join(texts.select("pos", F.substring("text", 1, chars).alias("passage")), "pos").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    ids = ranked.schema["query_id"].dataType.simpleString(), ranked.schema["pos"].dataType.simpleString()

    def fn(batches):
        for b in batches:
            s = scorer(b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([round(float(x), 6) for x in s], pa.float64())], names=["query_id", "pos", "score"])

    scored = pairs.select("query_id", "pos", "question", "passage").mapInArrow(fn, f"query_id {ids[0]}, pos {ids[1]}, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def pool(lists: list[DataFrame], gold: DataFrame, depth: int = 20) -> DataFrame:
    """Union of each method's first results, without known gold."""
    every = None
    for one in lists:
        part = one.where(F.col("rank") <= depth).select("query_id", "doc_id")
        every = part if every is None else every.unionByName(part)
    return every.distinct().join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def accumulated(found: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Union over rounds in order of first appearance (round, rank)."""
    first = found.groupBy(query, doc).agg(F.min(F.struct("round", "rank")).alias("first"))
    return first.select(query, doc, F.col("first.round").alias("round"), F.row_number().over(Window.partitionBy(query).orderBy("first")).alias("seen"))
