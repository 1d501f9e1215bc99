"""Model-backed steps with injected functions; the relational parts are here.

A generator maps a batch of prompts to replies.  It runs in Arrow batches on
the executors; a reply that can't be parsed gives no task, as an error does.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def ask(prompts: DataFrame, generator: Callable[[list[str]], list[str]], key: str = "task_id", attempts: int = 3) -> DataFrame:
    """(key, reply): a batch that fails is tried again, then gives nulls."""

    def fn(batches):
        for b in batches:
            replies = [None] * b.num_rows
            for _ in range(attempts):
                try:
                    replies = list(generator(b.column(1).to_pylist()))
                    break
                except Exception:  # noqa: BLE001 - whatever the service raises
                    continue
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(replies, pa.string())], names=[key, "reply"])

    return prompts.select(key, "prompt").mapInArrow(fn, f"{key} {prompts.schema[key].dataType.simpleString()}, reply string")


def cluster_prompts(members: DataFrame, instruction: str, key: str = "task_id") -> DataFrame:
    """(task_id, prompt, doc_ids): the papers of each cluster as blocks.

    members is (task_id, ordinal, doc_id, title, year, abstract, mesh_terms).
    """
    block = T.paper_block(F.col("ordinal"), F.col("title"), F.col("year"), F.col("abstract"), F.col("mesh_terms"))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", block.alias("block"), "doc_id")))
    out = members.groupBy(key).agg(rows.alias("rows"))
    return out.select(key, F.concat(F.lit(instruction + "\n\n"), F.array_join(F.transform("rows", lambda x: x["block"]), "\n\n")).alias("prompt"), F.transform("rows", lambda x: x["doc_id"]).alias("doc_ids"))


def facts(replies: DataFrame, key: str = "task_id", schema: str = "array<map<string, string>>") -> DataFrame:
    """(key, place, fact): elements of the array that each reply holds."""
    return replies.select(key, F.posexplode(F.from_json(T.json_array("reply"), schema)).alias("place", "fact"))


def tasks_from_replies(replies: DataFrame, clusters: DataFrame, method: str, key: str = "task_id") -> DataFrame:
    """Tasks of replies that parse and hold a question.

    An abstention task has no gold, and its cluster as near misses; any other
    has the cluster as gold.  clusters is (task_id, task_family, difficulty,
    doc_ids).
    """
    body = F.from_json(T.json_object("reply"), "question string, required_constraints array<struct<type: string, value: string>>, expected_answer_type string, reference_answer string")
    none = F.array().cast("array<string>")
    absent = F.col("task_family") == "abstention"
    docs = F.transform("doc_ids", lambda d: d.cast("string"))
    both = replies.join(clusters, key).withColumn("b", body).where("b.question <> ''")
    return both.select(key, "task_family", "difficulty", "b.question", F.coalesce("b.required_constraints", F.array().cast("array<struct<type: string, value: string>>")).alias("required_constraints"),
                       F.when(absent, none).otherwise(docs).alias("supporting_doc_ids"), F.when(absent, docs).otherwise(none).alias("hard_negative_doc_ids"),
                       "b.expected_answer_type", "b.reference_answer", F.lit(method).alias("generation_method"), F.size("doc_ids").alias("cluster_size"))


def judged(clusters: DataFrame, replies: DataFrame, shown: int = 25, cap: int = 15, fallback: int = 6, key: str = "task_id") -> DataFrame:
    """(task_id, doc_ids): candidates that a numbered reply chose.

    Only the first ``shown`` were judged; no reply leaves the first ``fallback``.
    """
    first = F.slice("doc_ids", 1, shown)
    n = F.size(first)
    chosen = F.transform(T.numbered_choices("reply", n, cap), lambda i: F.element_at(first, i))
    return clusters.join(replies, key, "left").select(key, F.when(F.col("reply").isNull(), F.slice("doc_ids", 1, fallback)).otherwise(chosen).alias("doc_ids"))


def missing(wanted: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Resume: what an earlier run has not written yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def prompt_budget(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)
