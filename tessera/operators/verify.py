"""Verification of tasks against the corpus."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check(ranked: DataFrame, chunks: DataFrame, constraints: DataFrame, window: int = 50, supporting: int = 10, negatives: int = 10) -> DataFrame:
    """(query_id, doc_id, met, needed, kind, ordinal) of documents kept.

    ranked is (query_id, pos, rank) over chunks (pos, doc_id, text); only a
    document's best chunk counts.  constraints is (query_id, value).  All met
    makes a document supporting, some a hard negative; an empty value is never
    met, and a task without constraints has neither.
    """
    top = ranked.where(F.col("rank") <= window).join(chunks.select("pos", "doc_id", F.lower("text").alias("low")), "pos")
    best = top.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))).where("n = 1").drop("n")
    c = constraints.groupBy("query_id").agg(F.collect_list(F.lower("value")).alias("values"))
    met = F.size(F.filter("values", lambda v: (v != "") & F.contains(F.col("low"), v)))
    tested = best.join(c, "query_id").select("query_id", "doc_id", "pos", "rank", met.alias("met"), F.size("values").alias("needed")).where("met > 0")
    tested = tested.withColumn("kind", F.when(F.col("met") == F.col("needed"), "supporting").otherwise("hard_negative"))
    tested = tested.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank")))
    most = F.when(F.col("kind") == "supporting", supporting).otherwise(negatives)
    return tested.where(F.col("ordinal") <= most)


def passages(checked: DataFrame, chunks: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    """The first supporting passages of each task."""
    first = checked.where((F.col("kind") == "supporting") & (F.col("ordinal") <= most))
    return first.join(chunks.select("pos", F.substring("text", 1, chars).alias("text")), "pos").select("query_id", "ordinal", "doc_id", "text")


def verdicts(tasks: DataFrame, checked: DataFrame) -> DataFrame:
    """(query_id, family, supporting, negatives, status) for every task."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    counts = checked.groupBy("query_id").agg(n("supporting").alias("s"), n("hard_negative").alias("h"))
    s, h = F.coalesce("s", F.lit(0)), F.coalesce("h", F.lit(0))
    absent = F.when(s == 0, "auto_verified").when(s <= 2, "needs_review").otherwise("rejected")
    present = F.when(s >= 1, "auto_verified").when(h >= 1, "needs_review").otherwise("rejected")
    return tasks.join(counts, "query_id", "left").select("query_id", "family", s.alias("supporting"), h.alias("negatives"), F.when(F.col("family") == "abstention", absent).otherwise(present).alias("status"))


MOST_SENT = 16 << 20  # characters of items in one automaton


def verbatim(docs: DataFrame, items: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """(query_id, doc_id) of documents that hold an item's text as it stands.

    An Aho-Corasick automaton of the items goes over each document once, whatever
    their number; nothing is joined, and only the pairs leave the scan.  Items of
    more than ``most`` characters in all are taken in blocks, a scan each.  Empty
    items are in no document.
    """
    asked = items.where("text <> '' and query_id is not null").select("query_id", "text")
    blocks = -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // most)
    kinds = items.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema, out = f"query_id {kinds[0]}, doc_id {kinds[1]}", None
    for i in range(blocks):
        found = docs.where("text is not null").select("doc_id", "text").mapInArrow(_holders(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out.distinct()


def _holders(block: pa.Table):
    """For each batch of documents (doc_id, text), the items each of them holds."""
    ids, texts, kind = block["query_id"].to_pylist(), block["text"].to_pylist(), block.schema.field("query_id").type

    def fn(batches):
        owners: dict[str, list] = {}
        for i, t in zip(ids, texts):
            owners.setdefault(t, []).append(i)
        auto = ahocorasick.Automaton()
        for t in owners:
            auto.add_word(t, t)
        if owners:
            auto.make_automaton()
        for b in batches if owners else ():
            query, doc = [], []
            for d, text in zip(*b.columns):  # one text at a time is a Python object
                for t in {t for _, t in auto.iter(text.as_py())}:
                    query += owners[t]
                    doc += [d.as_py()] * len(owners[t])
            yield pa.RecordBatch.from_arrays([pa.array(query, kind), pa.array(doc, b.column(0).type)], names=["query_id", "doc_id"])

    return fn
