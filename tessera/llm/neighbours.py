"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised with a codebook of its
own, so ``k`` centroids a half make k * k cells.  A query visits cells in order
of the sum of its two centroid distances, which a heap over the two sorted lists
yields one by one, until they hold enough entries; those are ranked by their
exact Euclidean distance.  Every vector is an entry; the queries are the vectors
whose id is divisible by ``every`` (1 makes every vector a query).

How many entries are enough depends on the vectors, so it is measured: a bounded
number of probes finds its true neighbours in one linear pass, and the number is
the least with which the share ``recall`` of them would have been met.  It is
small for vectors with structure and a large part of the table for noise.

Cells that share a first-half centroid form a region.  The cells that a query
visits in a region come first in its order of second-half centroids, so a query
travels once to each region, with their number only.  Both sides of a region are
cut into parts of at most ``part`` rows, and each pair of parts is one group, so
neither a region with a third of the entries nor one that all queries visit
makes a long task.

The codebooks are fitted on ``sampled`` vectors, those whose ids hash least; all
vectors are indexed.  A half has ``MOST_CENTRES`` centroids at most, so that the
driver holds a megabyte-sized table of cell counts, whatever the input; only
those counts, the sample and the probes' neighbours reach it.

Defined results: rows with a null id, and vectors that are null, of another
length than most are (of equally common lengths the longest counts), or hold a
null or a value that isn't finite, are left out.  Rows that share an id count
once, with the least vector.  Equal distances rank by id.  A vector is not its
own neighbour; one with fewer than ``top`` others has them all.  A table without
a sound vector or without a query gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import scratch

TOP = 10
RECALL = 0.95
EVERY = 50
PROBES = 400
SAMPLED = 20_000
PART = 20_000
MOST_CENTRES = 1024
_ROWS = 2048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def to_centres(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances that don't depend on which rows stand together."""
    out = np.empty((len(x), len(centre)))
    for j in range(len(centre)):
        out[:, j] = ((x - centre[j]) ** 2).sum(1)
    return out


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a seeded k-means++ start; fewer where values repeat."""
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centre = np.empty((k, x.shape[1]))
    centre[0] = x[rng.integers(len(x))]
    near = ((x - centre[0]) ** 2).sum(1)
    for i in range(1, k):
        centre[i] = x[min(int(np.searchsorted(np.cumsum(near), rng.random() * near.sum())), len(x) - 1)]
        near = np.minimum(near, ((x - centre[i]) ** 2).sum(1))
    for _ in range(rounds):
        own = np.concatenate([squared(x[i : i + _ROWS], centre).argmin(1) for i in range(0, len(x), _ROWS)])
        for j in range(x.shape[1]):
            total = np.bincount(own, x[:, j], minlength=k)
            n = np.bincount(own, minlength=k)
            centre[:, j] = np.where(n > 0, total / np.maximum(n, 1), centre[:, j])
    return centre


def traverse(d1: np.ndarray, d2: np.ndarray, counts: list[list[int]], enough: int) -> dict[int, int]:
    """Cells in order of d1 + d2 until they hold enough entries.

    Gives for each first-half centroid how many second-half centroids, nearest
    first, are visited with it; ``counts`` is centroid x centroid.
    """
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, got, out = [(s1[0] + s2[0], 0, 0)], 0, {}
    while heap and got < enough:
        _, i, j = heap[0]
        region = o1[i]
        got += counts[region][o2[j]]
        out[region] = j + 1
        # one open pair a row; row i + 1 opens when row i gives its first
        if j + 1 < len(o2):
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _small(fn):
    """fn over batches of few rows, so that rows times centroids fit."""
    return lambda batches: fn(b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS))


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column.combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(n, -1)


def nearest(x: np.ndarray, entries: np.ndarray, ids: np.ndarray, own: np.ndarray, allowed: np.ndarray | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, place in entries, distance) of each row's nearest entries.

    Equal distances rank by id; an entry with the row's own id is passed over.
    """
    d = squared(x, entries)
    if allowed is not None:
        d[~allowed] = np.inf
    d[own[:, None] == ids[None]] = np.inf
    wide = min(top + 8, d.shape[1])
    at = np.argpartition(d, wide - 1, axis=1)[:, :wide]
    at = np.take_along_axis(at, np.argsort(ids[at], axis=1), axis=1)
    approx = np.take_along_axis(d, at, axis=1)
    exact = np.sqrt(((entries[at] - x[:, None]) ** 2).sum(2))
    exact[np.isinf(approx)] = np.inf
    order = np.argsort(exact, axis=1, kind="stable")
    at, exact = np.take_along_axis(at, order, axis=1), np.take_along_axis(exact, order, axis=1)
    if wide < d.shape[1] and wide > top:
        # where the margin holds equal distances only, look at all of them
        for i in np.flatnonzero(np.isfinite(exact[:, top - 1]) & (exact[:, -1] <= exact[:, top - 1] + 1e-6)):
            all_ = np.flatnonzero(d[i] <= (exact[i, top - 1] + 1e-6) ** 2 + 1e-6)
            e = np.sqrt(((entries[all_] - x[i]) ** 2).sum(1))
            best = np.lexsort((ids[all_], e))[:top]
            at[i, :top], exact[i, :top] = all_[best], e[best]
    at, exact = at[:, :top], exact[:, :top]
    row, col = np.nonzero(np.isfinite(exact))
    return row, at[row, col], exact[row, col]


def seen_before(grid: np.ndarray, counts: np.ndarray, cells: list[tuple[int, int]]) -> list[int]:
    """Entries in the cells that are nearer than each of the given ones."""
    return [int(counts[grid < grid[c]].sum()) for c in cells]


def neighbours(vectors: DataFrame, top: int = TOP, recall: float = RECALL, k: int | None = None, every: int = EVERY, probes: int = PROBES, sampled: int = SAMPLED, part: int = PART) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance) of every query's nearest vectors."""
    spark = vectors.sparkSession
    schema = "vec_id long, neighbour_id long, rank int, distance double"
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = scratch.table(clean.where(sound).groupBy("id").agg(F.min("v").alias("v")))
    sizes = sorted(((r["count"], r["n"]) for r in clean.groupBy(F.size("v").alias("n")).count().collect()), reverse=True)
    if not sizes or sizes[0][1] == 0:
        return spark.createDataFrame([], schema)
    total, width = sizes[0]
    whole, clean = clean, clean.where(F.size("v") == width)
    k = min(k or max(8, int(np.ceil(np.sqrt(total / 12)))), MOST_CENTRES)
    half = max(width // 2, 1)
    drawn = clean.orderBy(F.xxhash64("id"), "id").limit(sampled).toArrow()
    sample, sample_ids = _matrix(drawn["v"]), drawn["id"].to_numpy()
    books = codebook(sample[:, :half], k), codebook(sample[:, half:], k) if width > half else np.zeros((1, 0))

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(1))
            first, second = to_centres(x[:, :half], books[0]).argmin(1), to_centres(x[:, half:], books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), b.column(1)], names=["id", "region", "cell", "v"])

    entries = scratch.table(clean.mapInArrow(_small(assign), f"id long, region int, cell int, v array<{kind}>"))
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    filled = entries.groupBy("region", "cell").count().toArrow()  # at most MOST_CENTRES ** 2 rows
    counts[filled["region"].to_numpy(), filled["cell"].to_numpy()] = filled["count"].to_numpy()

    # how many entries the probes would have had to see
    probe, probe_ids = sample[:probes], sample_ids[:probes]

    def truth(batches):
        for b in batches:
            ids, x = np.asarray(b.column(0)), _matrix(b.column(3))
            row, at, d = nearest(probe, x, ids, probe_ids, None, top)
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(d), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))], names=["probe", "d", "region", "cell"])

    found = entries.mapInArrow(_small(truth), "probe int, d double, region int, cell int")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy("d", "region", "cell"))).where(F.col("n") <= top).collect()
    grids = [to_centres(probe[:, :half], books[0]), to_centres(probe[:, half:], books[1])]
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["probe"], []).append((r["region"], r["cell"]))
    before = [n for i, cells in by.items() for n in seen_before(grids[0][i][:, None] + grids[1][i][None], counts, cells)]
    enough = int(np.quantile(before, recall, method="higher")) + 1 if before else 1
    enough = max(enough, 4 * top)

    def visit(batches):
        grid = counts.tolist()
        for b in batches:
            x = _matrix(b.column(1))
            d1, d2 = to_centres(x[:, :half], books[0]), to_centres(x[:, half:], books[1])
            rows, regions, prefix = [], [], []
            for i in range(len(x)):
                own = traverse(d1[i], d2[i], grid, enough)
                rows += [i] * len(own)
                regions += own
                prefix += own.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int32()), b.column(0).take(at), pa.array(prefix, pa.int32()), b.column(1).take(at)], names=["region", "id", "cells", "v"])

    asking = clean.where(F.pmod("id", F.lit(every)) == 0)
    visits = scratch.table(asking.mapInArrow(_small(visit), f"region int, id long, cells int, v array<{kind}>"))
    held = {int(i): int(n) for i, n in enumerate(counts.sum(1))}
    asked = visits.groupBy("region").count().collect()  # at most MOST_CENTRES rows
    sides = [(r["region"], -(-r["count"] // part), -(-held[r["region"]] // part)) for r in asked if held[r["region"]]]
    if not sides:
        scratch.drop(whole, entries, visits)
        return spark.createDataFrame([], schema)
    parts = F.broadcast(spark.createDataFrame(sides, "region int, q int, e int"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = visits.join(parts, "region").withColumn("qp", own_of("q")).select("region", "qp", all_of("e").alias("ep"), "id", "cells", "v")
    right = entries.join(parts, "region").withColumn("ep", own_of("e")).select("region", all_of("q").alias("qp"), "ep", "id", "cell", "v")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            e, ids, cell = _matrix(right["v"]), right["id"].to_numpy(), right["cell"].to_numpy()
            q, own, prefix = _matrix(left["v"]), left["id"].to_numpy(), left["cells"].to_numpy()
            step = max(1, 2_000_000 // len(ids))
            for at in range(0, len(q), step):
                x = q[at : at + step]
                order = np.argsort(to_centres(x[:, half:], books[1]), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(x), 0), axis=1)
                allowed = (place < prefix[at : at + step, None])[:, cell]
                row, col, d = nearest(x, e, ids, own[at : at + step], allowed, top)
                out.append(pa.table({"vec_id": own[at + row], "neighbour_id": ids[col], "distance": d}))
        return pa.concat_tables(out) if out else pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    keys = ["region", "qp", "ep"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "vec_id long, neighbour_id long, distance double")
    best = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    near = scratch.table(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("vec_id", "neighbour_id", "rank", "distance"))
    scratch.drop(whole, entries, visits)
    return near
