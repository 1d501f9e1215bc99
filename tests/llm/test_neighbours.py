from __future__ import annotations

import numpy as np
import pandas as pd

from tessera.llm import neighbours as N
from tessera.llm import queries


def brute(ids, x, top):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = {}
    for i, own in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[i, j], ids[j]))
        out[own] = [ids[j] for j in order[:top]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x] if x is not None else None, 0) for i, x in rows], "vec_id long, embedding array<float>, distance int")


def test_traversal_visits_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(6), rng.random(6)
    counts = np.ones((6, 6), int).tolist()
    order = sorted((d1[i] + d2[j], i, j) for i in range(6) for j in range(6))
    for enough in (1, 7, 20, 36):
        got = N.traverse(d1, d2, counts, enough)
        rank = np.argsort(d2, kind="stable").tolist()
        assert {(i, rank[j]) for i, n in got.items() for j in range(n)} == {(i, j) for _, i, j in order[:enough]}


def test_query_recall(spark, sf):
    df = pd.read_parquet(f"{sf}/embeddings.parquet")
    want = brute(df.vec_id.tolist(), np.stack(df.embedding).astype(float), N.TOP)
    want = {i: x for i, x in want.items() if i % N.EVERY == 0}
    got = queries.op5_nearest_neighbours(spark, sf).toPandas()
    assert got.groupby("vec_id").size().eq(N.TOP).all() and set(got.vec_id) == set(want)
    hits = sum(n in want[v] for v, n in zip(got.vec_id, got.neighbour_id))
    assert hits >= 0.9 * N.TOP * len(want)


def test_awkward_rows_and_ties(spark):
    rows = [(1, [0, 0, 0, 1]), (2, [0, 0, 0, 1]), (2, [0, 0, 0, 1]), (3, [0, 0, 0, 1]), (4, [9, 9, 9, 9]), (5, None), (6, [1, 2]), (7, [float("nan")] * 4), (None, [0, 0, 0, 1]), (8, [float("inf")] * 4)]
    got = N.neighbours(table(spark, rows), top=3, every=1).orderBy("vec_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    assert by == {1: [2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 4], 4: [1, 2, 3]}


def test_a_null_inside_two_vectors_of_one_id_and_the_queries(spark):
    rows = spark.createDataFrame([(50, [0.0, 0.0]), (50, [5.0, 0.0]), (1, [1.0, None]), (2, [4.0, 0.0]), (3, [3.0, 0.0]), (-100, [5.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["neighbour_id"], r["rank"], r["distance"]) for r in N.neighbours(rows, top=2).orderBy("vec_id", "rank").collect()]
    assert got == [(-100, 2, 1, 1.0), (-100, 3, 2, 2.0), (50, 3, 1, 3.0), (50, 2, 2, 4.0)]
    assert N.neighbours(rows.where("vec_id between 1 and 9")).count() == 0


def test_recall_with_structure_sees_few_entries(spark):
    """Clustered vectors: recall holds and the hot cluster's copies do no harm."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 10
    x = np.concatenate([centres[rng.integers(40, size=2000)] + rng.normal(size=(2000, 8)), np.repeat(centres[:1], 1000, 0)]).astype(np.float32)
    got = N.neighbours(table(spark, list(enumerate(x))), top=10, every=25, part=100).toPandas()
    x = x.astype(float)
    d = ((x[::25, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(d)), np.arange(0, 3000, 25)] = np.inf
    kth = np.sqrt(np.sort(d, axis=1)[:, 9])
    assert got.groupby("vec_id").size().eq(10).all() and got.vec_id.nunique() == 120
    assert np.mean(got.distance.to_numpy() <= kth[got.vec_id.to_numpy() // 25] + 1e-9) >= 0.9


def test_empty_and_single(spark):
    assert N.neighbours(table(spark, [])).count() == 0
    assert N.neighbours(table(spark, [(1, [1, 2])]), every=1).count() == 0


def test_parts_of_a_busy_region(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4)) for i in range(120)]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    got = N.neighbours(table(spark, rows), top=5, part=7, every=1).toPandas()
    want = brute(list(range(120)), x, 5)
    assert np.mean([n in want[v] for v, n in zip(got.vec_id, got.neighbour_id)]) >= 0.9
    assert not got.duplicated(["vec_id", "neighbour_id"]).any()
