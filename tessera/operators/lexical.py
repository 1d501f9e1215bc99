"""BM25 over whole query tables.

Statistics (document frequencies, mean length) always cover the whole corpus and
cost one tokenising pass and one shuffle of the vocabulary with map-side counts.

An index that was built scores a batch of queries in a second pass without making
postings: query terms and weights are sent to the chunks, term counts are taken
within each chunk, and a task keeps the k best of each query (``best``), so the one
shuffle is that of the winners.  A large batch of queries is cut into groups, a scan
each; only where the terms of a single query are too many to send are postings joined.

An ``Index`` that was saved has postings in lists, one for each term and block of
chunks.  Lists are made within the blocks; saving moves them once, by term, and a
search moves those of its own terms, by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import store
from tessera.functions import text as T
from tessera.operators import best

K1, B, EPSILON = 1.5, 0.75, 0.25
MOST_SENT = 128 << 20  # bytes of query terms
MOST_HELD = 4 << 20  # results that a task holds
MOST_LEFT = 1 << 30  # bytes of results that all tasks give, unless fewer tasks than cores did
QUERY_BLOCK, CHUNK_BLOCK, LIST_BLOCK = 1024, 1024, 4096


@dataclass
class Index:
    """lists (term, block, and arrays pos, dl, tf), terms (term, df, idf), one row of
    totals (n, avgdl), the corpus's places (pos), and where it was just built its
    tokens (pos, tokens), which are then searched instead of the lists."""

    lists: DataFrame
    terms: DataFrame
    totals: DataFrame
    places: DataFrame
    tokens: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(term, pos, dl, tf)"""
        return _each(self.lists)

    def save(self, path: str) -> None:
        """Lists are clustered by term, so a query reads few row groups."""
        self.lists.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lists")
        for name in ("terms", "totals", "places"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("lists", "terms", "totals", "places")))


def _each(lists: DataFrame) -> DataFrame:
    """lists with pos, dl and tf of one posting a row."""
    rest = [c for c in lists.columns if c not in ("block", "pos", "dl", "tf")]
    return lists.select(*rest, F.explode(F.arrays_zip("pos", "dl", "tf")).alias("p")).select(*rest, "p.pos", "p.dl", "p.tf")


def tokenised(corpus: DataFrame, pos: str = "pos", text: str = "text") -> DataFrame:
    """Tokens of each chunk.  A table in fewer pieces than half the cores (one
    row group, say) is spread over them first; larger ones are never moved."""
    rows = corpus.select(F.col(pos).alias("pos"), F.col(text).alias("text"))
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    if 2 * rows.rdd.getNumPartitions() <= cores:
        rows = rows.repartition(cores)
    return rows.select("pos", T.tokens("text").alias("tokens"))


def term_statistics(tokenised_: DataFrame, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(terms, totals) from one pass: a marker row per chunk carries its length.

    A negative idf becomes epsilon times the mean idf.  The counts, one row a
    term, are written; everything later reads those.
    """
    marker = F.array(F.lit(None).cast("string"))
    each = tokenised_.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array_distinct("tokens"), marker)).alias("term"))
    counts = store.written(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl")))
    totals = counts.where("term is null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    df = counts.where("term is not null").select("term", "df")
    raw = df.crossJoin(totals.select("n"))  # totals is one row
    raw = raw.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.lit(epsilon) * F.avg("raw")).alias("floor"))
    terms = raw.crossJoin(floor).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return terms, totals


def build(corpus: DataFrame, pos: str = "pos", text: str = "text", only: DataFrame | None = None, epsilon: float = EPSILON, keep: bool = False) -> Index:
    """Index of a corpus; with ``only`` (term), lists of those terms alone.

    ``keep`` writes the lists; a search of this index needs none.
    """
    tokens = tokenised(corpus, pos, text)
    terms, totals = term_statistics(tokens, epsilon)
    lists = _lists(tokens.where("pos is not null"))
    if only is not None:
        lists = lists.join(only.select("term").distinct(), "term", "left_semi")
    return Index(store.written(lists) if keep else lists, terms, totals, corpus.select(F.col(pos).alias("pos")), tokens)


def _lists(tokens: DataFrame) -> DataFrame:
    """(term, block, pos, dl, tf): a row for each term of some chunks that lie together."""
    kind, rows = tokens.schema["pos"].dataType.simpleString(), LIST_BLOCK

    def fn(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in best.slices(batch, rows):
                pos, lists = part.column(0), part.column(1)
                size = pc.list_value_length(lists).to_numpy().astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(pos) + np.repeat(np.arange(len(pos)), size), return_counts=True)
                code, chunk = np.divmod(keys, len(pos))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]).astype(np.int32))
                arrays = (pos.take(pa.array(chunk)), pa.array(size[chunk], pa.int32()), pa.array(tf, pa.int32()))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(coded.dictionary), block)), *(pa.ListArray.from_arrays(ends, x) for x in arrays)], names=["term", "block", "pos", "dl", "tf"])
                block += 1

    return tokens.mapInArrow(fn, f"term string, block long, pos array<{kind}>, dl array<int>, tf array<int>")


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qtf): a repeated query token counts each time."""
    return queries.select(F.col(query).alias("query_id"), F.explode(T.tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _weighted(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, w), written."""
    return store.written(asked.join(terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")))


def score(index: Index, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, pos, score) of every posting that a query meets.

    Query terms of up to ``MOST_SENT`` bytes are sent to the lists, so that what the
    join multiplies is summed where it arises; a larger batch meets them in a shuffle
    by term, whose common terms are split as skew.
    """
    weighted = _weighted(asked, index.terms)
    small = (weighted.agg(F.sum(F.lit(64) + F.length("term"))).first()[0] or 0) <= MOST_SENT
    long = F.lit(1 - b) + b * F.col("dl") / F.col("avgdl")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * long)
    met = _each(index.lists.join(F.broadcast(weighted) if small else weighted, "term")).crossJoin(index.totals.select("avgdl"))
    return met.groupBy("query_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))


def _scan(chunks: DataFrame, listed: bool, weighted: DataFrame, k: int, weighers: list, signed: bool) -> DataFrame:
    """(method, query_id, pos, score): the k best of each query in each task.

    chunks is (pos, terms) or (pos, terms, weights), or the lists of an index, and
    weighted (query_id, term, w).  What tasks give grows with their number, so a large
    batch of queries has fewer of them.
    """
    spark, asked = chunks.sparkSession, weighted.select("query_id", "term", "w").toArrow()
    pos = chunks.schema["pos"].dataType
    kinds = weighted.schema["query_id"].dataType.simpleString(), (pos.elementType if listed else pos).simpleString()
    schema = f"method int, query_id {kinds[0]}, pos {kinds[1]}, score double"
    terms, blocks = best.blocks(asked, QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], schema)
    bytes_ = 24 * k * len(weighers) * sum(len(b.ids) for b in blocks)
    tasks = max(spark.sparkContext.defaultParallelism, MOST_LEFT // bytes_)
    held, rows, query_type = spark.sparkContext.broadcast((terms, blocks)), CHUNK_BLOCK, asked.schema.field("query_id").type

    def fn(batches):
        scan, kind = best.Scan(*held.value, k, weighers, signed), None
        if listed:
            for table in best.groups(batches, "block"):
                kind = table.schema.field("pos").type.value_type
                scan.add_lists(table["term"].combine_chunks(), *(table[c].combine_chunks() for c in ("pos", "dl", "tf")), rows)
        else:
            for batch in batches:
                kind = batch.column(0).type
                scan.add(*batch.columns[:3], rows=rows)
        for method, query, where, score in scan.results():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), method), pa.int32()), pa.array(query, query_type), pa.array(where, kind), pa.array(score)], names=["method", "query_id", "pos", "score"])

    if listed:
        own = spark.createDataFrame(pa.table({"term": terms}))
        found = chunks.join(F.broadcast(own), "term", "left_semi").select("block", "term", "pos", "dl", "tf")
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return found.repartition(min(spread, tasks), "block").sortWithinPartitions("block").mapInArrow(fn, schema)
    return (chunks.coalesce(tasks) if chunks.rdd.getNumPartitions() > tasks else chunks).mapInArrow(fn, schema)


def _best(chunks: DataFrame, listed: bool, weighted: DataFrame, k: int, weighers: list, signed: bool = False) -> DataFrame | None:
    """(method, query_id, pos, score, rank) by scans of the chunks, a scan for each
    group of queries whose terms and results are bounded in bytes; None where the
    terms of one query alone are too many to send."""
    one = weighted.groupBy("query_id").agg(F.sum(F.lit(64) + F.length("term")).alias("b"))
    total, most, many = one.agg(F.sum("b"), F.max("b"), F.count("*")).first()
    if (most or 0) > MOST_SENT:
        return None
    groups = max(1, -(-(total or 0) // max(1, MOST_SENT)), -(-many * k * len(weighers) // MOST_HELD))
    found = None
    for i in range(groups):
        part = weighted if groups == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == i)
        rows = _scan(chunks, listed, part, k, weighers, signed)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _saturated(k1: float, b: float, avgdl: float):
    return lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl))


def _searched(index: Index, asked: DataFrame, k: int, k1s: tuple[float, ...] = (K1,), b: float = B) -> list[DataFrame]:
    """(query_id, pos, score, rank) for each k1."""
    one = index.totals.first()
    avgdl = float((one and one["avgdl"]) or 1)
    listed = index.tokens is None
    chunks = index.lists if listed else index.tokens.where("pos is not null")
    found = _best(chunks, listed, _weighted(asked, index.terms), k, [_saturated(k1, b, avgdl) for k1 in k1s])
    if found is None:
        lists = store.written(index.lists.join(asked.select("term").distinct(), "term", "left_semi"))
        return [top_k(score(Index(lists, index.terms, index.totals, index.places), asked, k1, b), k) for k1 in k1s]
    if len(k1s) > 1:
        found = store.written(found)
    return [found.where(F.col("method") == i).drop("method") for i in range(len(k1s))]


def ranked(corpus: DataFrame, queries: DataFrame, k: int, k1s: tuple[float, ...] = (K1,), b: float = B, epsilon: float = EPSILON) -> list[DataFrame]:
    """(query_id, pos, score, rank) for each k1, from one scan of the chunks."""
    return _searched(build(corpus, epsilon=epsilon), query_terms(queries), k, k1s, b)


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query; equal scores keep corpus order."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pad_zero(scored: DataFrame, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Adds unmatched chunks at score 0 in corpus order.

    A list needs at most as many as it has places without a positive score, and
    they are the first of the corpus that it did not match; so only its first
    ``k + matched`` places are looked at, and only by the lists that are short.
    """
    asked = queries.select("query_id").distinct()
    held = scored.where("score > 0").groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("held"))
    needy = asked.join(held, "query_id", "left").select("query_id", (k - F.coalesce("held", F.lit(0))).alias("short")).where("short > 0")
    many = scored.join(needy, "query_id").groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("m")).first()["m"]
    first = index.places.orderBy("pos").limit(int(k + many)).select("pos")
    extra = needy.crossJoin(first).join(scored.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    extra = extra.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where("n <= short")
    return scored.unionByName(extra.select("query_id", "pos", F.lit(0.0).alias("score")))


def search(index: Index, queries: DataFrame, k: int, k1: float = K1, b: float = B, padded: bool = False) -> DataFrame:
    """(query_id, pos, score, rank): queries has query_id and text."""
    asked = query_terms(queries)
    if not padded:
        return _searched(index, asked, k, (k1,), b)[0]
    if index.terms.where("idf < 0").join(asked.select("term").distinct(), "term", "left_semi").take(1):
        scored = score(index, asked, k1, b)  # which places score below 0 isn't known from the best
    else:
        scored = store.written(_searched(index, asked, k, (k1,), b)[0].where("score > 0").select("query_id", "pos", "score"))
    return top_k(pad_zero(scored, index, queries, k), k)


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, padded: bool = False) -> DataFrame:
    """One batch of queries over a corpus (pos, text)."""
    return search(build(corpus), queries, k, k1, b, padded)


def topic_clusters(corpus: DataFrame, seeds: DataFrame, k: int = 40, oversample: int = 3, chars: int = 500, least: int = 100) -> DataFrame:
    """(query_id, pos, score, rank): chunks like each seed chunk, itself left out.

    The seed's first ``chars`` characters are the query; of its k * oversample
    results those longer than ``least`` characters stay, the first k.  seeds is
    (pos, text), a part of corpus.
    """
    asked = seeds.select(F.col("pos").alias("query_id"), F.substring("text", 1, chars).alias("text"))
    long = corpus.where(F.length("text") > least).select("pos")
    kept = bm25(corpus, asked, k * oversample).where("pos <> query_id").join(long, "pos", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def sparse(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, score, rank): inner products of learned sparse vectors.

    vectors is (pos, terms, weights) with a vector a row, which is scanned, or
    (pos, term, weight); asked is (query_id, term, weight); both from an encoder of
    the caller's.
    """
    own = asked.select("query_id", "term", F.col("weight").alias("w"))
    if "terms" in vectors.columns:
        found = _best(vectors.select("pos", "terms", "weights").where("pos is not null"), False, store.written(own), k, [lambda weight, size: weight], signed=True)
        if found is not None:
            return found.drop("method")
        vectors = vectors.select("pos", F.explode(F.arrays_zip("terms", "weights")).alias("v")).select("pos", F.col("v.terms").alias("term"), F.col("v.weights").alias("weight"))
    small = (own.agg(F.sum(F.lit(64) + F.length("term"))).first()[0] or 0) <= MOST_SENT
    met = vectors.join(F.broadcast(own) if small else own, "term")
    return top_k(met.groupBy("query_id", "pos").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score")), k)


def counted(tokens: DataFrame) -> DataFrame:
    """(pos, terms, counts): each chunk's distinct tokens and how often it has them."""
    kind, rows = tokens.schema["pos"].dataType.simpleString(), CHUNK_BLOCK

    def fn(batches):
        for batch in batches:
            for part in best.slices(batch, rows):
                lists = part.column(1)
                coded = lists.flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                keys, tf = np.unique(np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy()) * many + coded.indices.to_numpy(), return_counts=True)
                chunk, code = np.divmod(keys, many)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=len(part)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["pos", "terms", "counts"])

    return tokens.mapInArrow(fn, f"pos {kind}, terms array<string>, counts array<int>")


def rm3(index: Index, queries: DataFrame, k: int, feedback: int = 10, terms: int = 10, weight: float = 0.5, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 with relevance-model expansion from each query's first results.

    Needs an index of all terms.  Term weights of the feedback documents
    are tf / length times the document's share of the score.
    """
    asked = query_terms(queries)
    first = _searched(index, asked, feedback, (k1,), b)[0].where("score > 0")
    share = store.written(first.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))))
    seen = store.sent(share.select("pos").distinct())
    if index.tokens is None:
        postings = index.postings.join(seen, "pos", "left_semi")
    else:
        own = index.tokens.join(seen, "pos", "left_semi").select("pos", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        postings = own.groupBy("term", "pos", "dl").agg(F.count("*").alias("tf"))
    model = share.join(postings, "pos").groupBy("query_id", "term").agg(F.sum(F.col("share") * F.col("tf") / F.col("dl")).alias("p"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("p", 9)), "term")
    model = model.withColumn("n", F.row_number().over(best)).where(F.col("n") <= terms)
    model = model.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("query_id")))
    own = asked.withColumn("q", F.col("qtf") / F.sum("qtf").over(Window.partitionBy("query_id")))
    mixed = own.select("query_id", "term", (weight * F.col("q")).alias("w")).unionByName(model.select("query_id", "term", ((1 - weight) * F.col("p")).alias("w")))
    return _searched(index, mixed.groupBy("query_id", "term").agg(F.sum("w").alias("qtf")), k, (k1,), b)[0]


def grep(corpus: DataFrame, pattern: str, most: int = 20, pos: str = "pos", text: str = "text") -> DataFrame:
    """The first chunks, in corpus order, that the pattern is found in."""
    hit = corpus.where(F.col(text).rlike(f"(?i){pattern}"))
    return hit.orderBy(pos).limit(most).withColumn("score", F.lit(1.0))


def snippet(text: Column | str, most: int = 300) -> Column:
    return F.substring(text, 1, most)
