"""Exact inner-product search over whole query tables.

Vectors are scaled to length 1.  Both sides are cut into blocks, each pair of
blocks is an Arrow group of matrix products, and only the best of a block pair
leave it; neither side is broadcast or collected.  There are as few blocks as give
every core some pairs, until a block reaches its bytes: each side is moved as often
as the other has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES = 64 << 20  # of one side of a block pair, as doubles
SLACK = 1e-6  # scores are rounded to six places once they are candidates
SPREAD = 2  # block pairs for each core, where blocks can be smaller


def normalised(vector: Column | str, floor: float = 0.0) -> Column:
    """Scaled to length 1; a length of 0 counts as 1, one below floor as floor."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    by = F.greatest(size, F.lit(floor)) if floor else F.when(size == 0, 1.0).otherwise(size)
    return F.transform(v, lambda x: x / by)


def encode(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray], pos: str = "pos", text: str = "text") -> DataFrame:
    """(pos, vector) by an injected encoder that takes a batch of texts."""

    def fn(batches):
        for b in batches:
            v = np.asarray(encoder(b.column(1).to_pylist()), np.float64)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v / np.where(size == 0, 1, size)), pa.list_(pa.float64()))], names=["pos", "vector"])

    return chunks.select(F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(fn, "pos long, vector array<double>")


def _blocks(df: DataFrame, key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def save(vectors: DataFrame, path: str, model: str) -> None:
    """An index: (pos, vector) of one model, scaled to length 1, in order of pos
    within its files."""
    scaled = vectors.select("pos", normalised("vector").alias("vector")).where("vector is not null")
    scaled.sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/model={model}")


def load(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(pos, vector) as ``save`` wrote it; another model's files are not read."""
    return spark.read.parquet(f"{path}/model={model}")


def late_interaction(ranked: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, pos, score, rank): candidates by the sum, over a query's token
    vectors, of the best inner product with a token vector of the passage.

    ranked is (query_id, pos), queries (query_id, vectors), passages (pos, vectors).
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    both = ranked.select("query_id", "pos").join(queries.select("query_id", F.col("vectors").alias("__q")), "query_id").join(passages.select("pos", F.col("vectors").alias("__p")), "pos")
    best = F.transform("__q", lambda q: F.coalesce(F.array_max(F.transform("__p", lambda p: dot(q, p))), F.lit(0.0)))
    scored = both.select("query_id", "pos", F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def _kept(parts: list[tuple], k: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What reaches each row's k-th score, which goes to low; all that tie with it stay."""
    row, col, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((-score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == k - 1
    low[row[last]] = score[last]
    stay = score >= low[row] - SLACK / 2
    return row[stay], col[stay], score[stay]


def _grid(entries: int, queries: int, cores: int, most: int, few: int = 256) -> tuple[int, int]:
    """(blocks of entries, blocks of queries): blocks of at most ``most`` rows, some
    pairs for each core, and as little to move as that allows."""
    ne, nq = max(1, -(-entries // most)), max(1, -(-queries // most))
    while ne * nq < SPREAD * cores:  # the side whose blocks are larger is cut further
        if max(entries / ne, queries / nq) <= few:
            break
        ne, nq = (ne + 1, nq) if entries / ne >= queries / nq else (ne, nq + 1)
    return ne, nq


def search(entries: DataFrame, queries: DataFrame, k: int, oversample: int = 1, exclude_self: bool = False, block: int | None = None) -> DataFrame:
    """(query_id, pos, score, rank) of the k * oversample best entries.

    entries has (pos, vector), queries (query_id, vector).  Scores are rounded
    to 6 places before they rank; equal ones keep corpus order.
    """
    wanted = k * oversample
    e = entries.select("pos", F.col("vector").alias("v")).where("v is not null")
    q = queries.select("query_id", F.col("vector").alias("v")).where("v is not null")
    width = (entries.agg(F.max(F.size("vector"))).first()[0] or 1) if block is None else 1
    most = max(1, BLOCK_BYTES // (8 * width)) if block is None else block
    ne, nq = _grid(entries.count(), queries.count(), entries.sparkSession.sparkContext.defaultParallelism, most)
    left = q.withColumn("qb", _blocks(q, "query_id", nq)).withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(ne - 1))))
    right = e.withColumn("eb", _blocks(e, "pos", ne)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    names = [left.schema["query_id"].dataType.simpleString(), right.schema["pos"].dataType.simpleString()]

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": a["query_id"].slice(0, 0), "pos": b["pos"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return empty
        x, y = (np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (a, b))
        by_x, by_y = (np.sqrt((v * v).sum(1)) for v in (x, y))
        x, y = x / np.maximum(by_x, 1e-8)[:, None], y / np.where(by_y == 0, 1, by_y)[:, None]  # as normalised
        whole = np.isfinite(by_y)
        y, b_pos = y[whole], b["pos"].to_numpy()[whole]
        a_id = a["query_id"].to_numpy()
        if not len(y):
            return empty
        out = []
        for at in range(0, len(x), 256):
            own, left = a_id[at : at + 256], []
            low = np.full(len(own), -np.inf)  # the last place so far
            for by in range(0, len(y), 4096):
                s = x[at : at + 256] @ y[by : by + 4096].T
                if exclude_self:
                    s[own[:, None] == b_pos[None, by : by + 4096]] = -np.inf
                if s.shape[1] > wanted and (new := np.flatnonzero(np.isneginf(low))).size:
                    low[new] = np.partition(s[new], s.shape[1] - wanted, axis=1)[:, s.shape[1] - wanted]
                row, col = np.nonzero((s >= low[:, None] - SLACK) & np.isfinite(s))
                left.append((row, by + col, np.round(s[row, col], 6)))
                if by + 4096 < len(y) and len(left) > 1:
                    left = [_kept(left, wanted, low)]
            row, col, score = _kept(left, wanted, low)
            out.append(pa.table({"query_id": own[row], "pos": b_pos[col], "score": score}))
        return pa.concat_tables(out)

    found = left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInArrow(product, f"query_id {names[0]}, pos {names[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
