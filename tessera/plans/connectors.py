"""Queries for connectors, sinks, saved indexes, the engine's tools and streams.

Services are stand-ins that compute a payload from its key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tessera import store
from tessera.operators import lexical
from tessera.plans import queries as base
from tessera.plans import sql
from tessera.plans.engine import EvidenceEngine
from tessera.plans.registry import query, table
from tessera.sources import connect
from tessera.streaming import ingest

_FAST = 1e9


def _folder(spark, name: str) -> str:
    return f"{store.shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex}"


def _record(key: str) -> str:
    return json.dumps({"id": key, "size": int(key) * 3})


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id * 3 ELSE -1 END AS size FROM documents")
def fetched_records(spark, d):
    """Records by key, in batches at a bounded rate; a miss has no payload."""
    got = connect.fetch(table(spark, d, "documents"), "doc_id", lambda keys: {k: _record(k) for k in keys if int(k) % 7}, per_second=_FAST, streams=2)
    return got.select("doc_id", F.coalesce(F.get_json_object("payload", "$.size").cast("long"), F.lit(-1)).alias("size"))


@query("SELECT doc_id::VARCHAR AS doc_id, doc_id * 3 AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fetched_new_only(spark, d):
    """Resume: only keys that an earlier run has not stored are asked for."""
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    keys = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    got = connect.fetch_new(keys, done, "doc_id", lambda keys: {k: _record(k) for k in keys}, per_second=_FAST)
    return got.select("doc_id", F.get_json_object("payload", "$.size").cast("long").alias("size"))


def _filtered(asked: str) -> list[str]:
    """Records that a filter 'ids.pmid:a|b' asks for, the last first, some absent."""
    keys = asked.partition(":")[2].split("|")
    return [_record(k) for k in reversed(keys) if int(k) % 5]


@query("SELECT doc_id::VARCHAR AS pmid, CASE WHEN doc_id % 5 <> 0 THEN doc_id * 3 ELSE -1 END AS size FROM documents")
def batch_lookup(spark, d):
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("pmid"))
    got = connect.lookup(keys, "pmid", "ids.pmid", _filtered, lambda x: json.loads(x)["id"], per_second=_FAST)
    return got.select("pmid", F.coalesce(F.get_json_object("payload", "$.size").cast("long"), F.lit(-1)).alias("size"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '/works/doi:10.1/' || p_partkey ELSE '/works/pmid:' || p_partkey END AS path FROM part")
def lookup_paths(spark, d):
    k = F.col("p_partkey").cast("string")
    doi = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://doi.org/10.1/"), k)).otherwise(F.concat(F.lit("10.1/"), k))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, connect.lookup_path("doi", doi)).otherwise(connect.lookup_path("pmid", k)).alias("path"))


def _page(asked: str, cursor: str | None) -> tuple[list, str | None]:
    at = int(cursor or 0)
    total = 30 * (1 + len(asked) % 4)
    return [f"{asked}-{i}" for i in range(at, min(at + 25, total))], str(at + 25) if at + 25 < total else None


@query("SELECT n AS query_ord, source AS query, i AS place, source || '-' || i AS result FROM (SELECT source, row_number() OVER (ORDER BY source) AS n FROM (SELECT DISTINCT source FROM documents)), range(70) r(i) WHERE i < 30 * (1 + length(source) % 4)")
def paged_search(spark, d):
    """Cursor pages until they end or 70 results are there."""
    from pyspark.sql.window import Window

    q = table(spark, d, "documents").select(F.col("source").alias("query")).distinct()
    q = q.withColumn("query_ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("query")))
    return connect.search(q, _page, most=70, per_second=_FAST)


@query("SELECT doc_id, md5(text) AS text_md5, 'none' AS venue FROM documents")
def json_lines(spark, d):
    """Written as JSON lines, split by language, and read with a schema."""
    path = _folder(spark, "json_lines")
    connect.write_json_lines(table(spark, d, "documents").select("doc_id", "text", "lang"), path, ["lang"])
    back = connect.read_json_lines(spark, path, "doc_id long, text string, venue string", {"venue": "none"})
    return back.select("doc_id", F.md5("text").alias("text_md5"), "venue")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'exists' WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'saved' END AS status, CASE WHEN doc_id IN (SELECT doc_id FROM labels) OR doc_id % 7 = 0 THEN 0 ELSE 8 + length(source) END AS n_chars FROM documents WHERE lang = 'es'")
def text_files(spark, d):
    """One file a document, none that is there already; the log of it."""
    docs = table(spark, d, "documents").where("lang = 'es'")
    payload = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("<p>"), "source", F.lit("</p>\n")))
    return connect.save_texts(docs.select("doc_id", payload.alias("payload")), table(spark, d, "labels"), "doc_id", _folder(spark, "text_files"))


@query("SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id")
def trace_files(spark, d):
    """One JSON object a task, read back."""
    path = _folder(spark, "trace_files")
    connect.write_traces(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("round"), "role"), path, "conv_id")
    back = spark.read.schema("conv_id long, rounds array<struct<round: long, role: string>>").json(path)
    return back.select("conv_id", F.size("rounds").alias("n"), F.col("rounds")[0]["round"].alias("first"), F.element_at("rounds", -1)["round"].alias("last"))


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 10), select="SELECT query_id, doc_id, score, rank FROM best"))
def saved_index(spark, d):
    """Postings and statistics written, read again and searched."""
    path = _folder(spark, "saved_index")
    lexical.build(base._chunks(spark, d)).save(path)
    return lexical.search(lexical.Index.load(spark, path), base._items(spark, d), 10).select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 60), "placed AS (SELECT b.*, source FROM best b JOIN lens USING (doc_id))", sql.dedup("one", "placed", 20), select="SELECT query_id, source, doc_id, score, rank FROM one"))
def tool_by_name(spark, d):
    """A search as agents call it, by the tool's name."""
    chunks = base._chunks(spark, d)
    engine = EvidenceEngine(table(spark, d, "documents"), chunks)
    return engine.tool("search_lexical")(base._items(spark, d)).select("query_id", F.col("doc_id").alias("source"), F.col("pos").alias("doc_id"), "score", "rank")


def _streamed(spark, frame, mode: str, name: str):
    """All that is there now, through a stream into a table."""
    path = _folder(spark, name)
    run = frame.writeStream.outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True)
    run.foreachBatch(lambda part, _: part.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def _events(spark, d):
    """The table as a stream."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, d):
    """Keys of a stream, each taken once."""
    return _streamed(spark, ingest.first_seen(_events(spark, d), "user_id", "ts").select("user_id"), "append", "stream_first_seen")


@query("SELECT strftime(date_trunc('hour', ts::TIMESTAMP), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, d):
    """Counts of a stream in hourly windows."""
    got = _streamed(spark, ingest.rolling_counts(_events(spark, d), "ts", "event_type"), "complete", "stream_counts")
    return got.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")
