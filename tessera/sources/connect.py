"""Connectors: injected fetchers run in batches, resumable, at a bounded rate.

No service is called here.  A fetcher is a function from a batch of keys to
payloads (None on a miss); searches page until they are exhausted.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import store


class Pace:
    """Sleeps so that calls are at least 1 / per_second apart."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1 / per_second, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.gap:
            self.sleep(self.gap - (now - self.last))
        self.last = self.clock()


def fetch(keys: DataFrame, key: str, fetcher: Callable[[list[str]], dict], batch: int = 200, per_second: float = 3.0, streams: int = 1) -> DataFrame:
    """(key, payload): null where the fetcher has none.

    ``streams`` partitions call at once, each at its share of the rate.
    """

    def fn(batches):
        pace = Pace(per_second / streams)
        for b in batches:
            asked = b.column(0).to_pylist()
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                pace.wait()
                got = fetcher(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([got.get(k) for k in part], pa.string())], names=[key, "payload"])

    return keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().repartition(streams).mapInArrow(fn, f"{key} string, payload string")


def fetch_new(keys: DataFrame, done: DataFrame, key: str, fetcher: Callable[[list[str]], dict], **how) -> DataFrame:
    """As fetch, for the keys that an earlier run has not stored."""
    return fetch(keys.join(done.select(key).distinct(), key, "left_anti"), key, fetcher, **how)


def lookup_path(kind: str, value: Column | str) -> Column:
    """Path of one record by its 'doi' (bare or as a URL), 'pmid' or 'pmcid'."""
    value = F.col(value) if isinstance(value, str) else value
    bare = F.regexp_replace(value, r"^https?://(dx\.)?doi\.org/", "") if kind == "doi" else value
    return F.concat(F.lit(f"/works/{kind}:"), bare)


def lookup(keys: DataFrame, key: str, field: str, fetcher: Callable[[str], list[str]], key_of: Callable[[str], str | None], batch: int = 50, per_second: float = 10.0, streams: int = 1) -> DataFrame:
    """(key, payload): records of many keys by one filter 'field:a|b|c' a request.

    Records come back in any order and without some; ``key_of`` reads a record's
    own key, and the last record of a key counts.
    """

    def answer(part: list[str]) -> dict:
        return {key_of(x): x for x in fetcher(f"{field}:{'|'.join(part)}")}

    return fetch(keys, key, answer, batch, per_second, streams)


def save_texts(found: DataFrame, done: DataFrame, key: str, path: str, suffix: str = "xml") -> DataFrame:
    """Writes one file for each new key, as ``path/<key>=<id>``, and gives the log
    (key, status, n_chars): 'saved', 'exists' or 'missing'.

    found is (key, payload) as ``fetch`` gives it, done (key) what is there.
    """
    there = done.select(key).distinct().withColumn("__there", F.lit(True))
    log = store.written(found.select(key, "payload").join(there, key, "left"))
    fresh = log.where("payload is not null and __there is null")
    fresh.select(key, F.col("payload").alias("value")).write.mode("append").partitionBy(key).option("lineSep", "\n").text(f"{path}/{suffix}")
    status = F.when(F.col("__there"), "exists").when(F.col("payload").isNull(), "missing").otherwise("saved")
    return log.select(key, status.alias("status"), F.when(status == "saved", F.length("payload")).otherwise(0).alias("n_chars"))


def write_traces(trace: DataFrame, path: str, key: str = "query_id", apart: bool = False) -> None:
    """One JSON object a task, a line each: its rounds in order, each with all other
    columns.  A file holds many tasks, as a file each costs far more than its rows;
    ``apart`` gives each task its own, in ``task=<id>``."""
    rest = [c for c in trace.columns if c not in (key, "round")]
    rounds = F.array_sort(F.collect_list(F.struct("round", *rest)))
    tasks = trace.groupBy(key).agg(rounds.alias("rounds"))
    if apart:
        tasks.withColumn("task", F.col(key)).write.mode("overwrite").partitionBy("task").json(path)
    else:
        tasks.write.mode("overwrite").json(path)


def pages(first: str, page: Callable[[str, str | None], tuple[list, str | None]], most: int) -> Iterator[str]:
    """Results of a cursor-paged search, in order, at most ``most``."""
    cursor, n = None, 0
    while n < most:
        found, cursor = page(first, cursor)
        for x in found[: most - n]:
            yield x
        n += len(found)
        if not found or cursor is None:
            return


def search(queries: DataFrame, page: Callable[[str, str | None], tuple[list, str | None]], most: int = 10_000, per_second: float = 3.0) -> DataFrame:
    """(query_ord, query, place, result): each query pages on its own."""

    def fn(batches):
        pace = Pace(per_second)

        def paced(q, c):
            pace.wait()
            return page(q, c)

        for b in batches:
            for o, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = list(pages(q, paced, most))
                yield pa.RecordBatch.from_arrays([pa.array([o] * len(got), pa.int32()), pa.array([q] * len(got), pa.string()), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], names=["query_ord", "query", "place", "result"])

    rows = queries.select(F.col("query_ord").cast("int").alias("query_ord"), "query")
    return rows.mapInArrow(fn, "query_ord int, query string, place int, result string")


def id_map(links: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """key -> value: first link within a set, a later set wins."""
    return links.groupBy(key).agg(F.max_by(value, F.struct("set_no", -F.col(ordinal))).alias(value))


def read_json_lines(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON lines with a schema; a missing key gets its default."""
    df = spark.read.schema(schema).json(path)
    return df.fillna(defaults) if defaults else df


def write_json_lines(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_files(spark: SparkSession, path: str, key: str = "pmcid", text: str = "xml") -> DataFrame:
    """One row a file: its name without the ending, and its text."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias(key), F.decode("content", "UTF-8").alias(text))
