"""The kernel that keeps the k best chunks of each query, against plain sums."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import best, lexical, verify
from test_text import plain_tokens


def plain(chunks: dict, asked: dict, k: int, k1: float, avg: float) -> dict:
    out = {}
    for q, weights in asked.items():
        got = []
        for pos, words in chunks.items():
            met = [t for t in weights if t in words]
            if met:
                tf = {t: words.count(t) for t in met}
                got.append((-round(sum(weights[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (0.25 + 0.75 * len(words) / avg)) for t in met), 6), pos))
        out[q] = sorted(got)[:k]
    return out


@pytest.mark.parametrize("dense", [0.01, 4, 1e9])
@pytest.mark.parametrize("low", [0.1, -1.0])
def test_best_of_many_batches(monkeypatch, dense, low):
    """All terms by product, some, none; weights of either sign; slices cut anywhere."""
    monkeypatch.setattr(best, "DENSE", dense)
    monkeypatch.setattr(best, "PAIRS", 50)
    monkeypatch.setattr(best, "SLICE_TERMS", 40)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    chunks = {f"p{i}": rng.choices(vocabulary, weights=range(1, 31), k=rng.choice((0, 1, 9, 60))) for i in range(80)}
    asked = {q: {t: rng.choice((low, 0.0, 1.5, 2.5)) for t in rng.sample(vocabulary + ["absent"], 5)} for q in range(11)}
    rows = [(q, t, w) for q, ws in asked.items() for t, w in ws.items()]
    table = pa.table({"query_id": [r[0] for r in rows], "term": [r[1] for r in rows], "w": [r[2] for r in rows]})
    avg = sum(map(len, chunks.values())) / len(chunks)
    terms, blocks = best.blocks(table, 4)
    scan = best.Scan(terms, blocks, 6, [lambda tf, size, k1=k1: tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * size / avg)) for k1 in (1.5, 1.2)])
    for at in range(0, 80, 23):
        part = dict(list(chunks.items())[at : at + 23])
        scan.add(pa.array(list(part)), pa.array(list(part.values()), pa.list_(pa.string())), rows=7)
    got = [{q: [] for q in asked}, {q: [] for q in asked}]
    for method, query, pos, score in scan.results():
        for q, p, s in zip(query.tolist(), pos.tolist(), score.tolist()):
            got[method][q].append((-s, p))
    for method, k1 in enumerate((1.5, 1.2)):
        for q, want in plain(chunks, asked, 6, k1, avg).items():
            have = sorted(got[method][q])
            assert [p for _, p in have] == [p for _, p in want] and np.allclose([s for s, _ in have], [s for s, _ in want], atol=2e-6), (q, k1)


def test_a_task_gives_k_results_a_query(spark, monkeypatch):
    """What leaves a task doesn't grow with its chunks, only with tasks, queries and k."""
    monkeypatch.setattr(lexical, "CHUNK_BLOCK", 16)
    chunks = spark.range(600).select(F.col("id").alias("pos"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("w"), F.col("id") % 13)).alias("text")).repartition(3, "pos")
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text"))
    index = lexical.build(chunks)
    weighted = lexical._weighted(lexical.query_terms(asked), index.terms)
    left = lexical._scan(index.tokens, False, weighted, 5, [lambda tf, size: tf], False)
    assert left.count() <= left.rdd.getNumPartitions() * 20 * 5
    monkeypatch.setattr(lexical, "MOST_LEFT", 0)
    assert lexical._scan(index.tokens.repartition(40), False, weighted, 5, [lambda tf, size: tf], False).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_groups_of_queries_and_lists_equal_one_scan(spark, sf, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("pos"), "text").where("length(text) < 3000")
    asked = docs.where("pos % 9 = 0").select(F.col("pos").alias("query_id"), F.substring("text", 1, 200).alias("text"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "pos", "score", "rank").collect()))
    want = rows(lexical.bm25(docs, asked, 7))
    index = lexical.build(docs)
    index.save(str(tmp_path))
    again = lexical.Index.load(spark, str(tmp_path))
    assert want and rows(lexical.search(again, asked, 7)) == want
    assert again.postings.count() == index.postings.count() == docs.select(F.explode(F.array_distinct(lexical.T.tokens("text")))).count()
    monkeypatch.setattr(lexical, "MOST_HELD", 60)
    assert rows(lexical.search(index, asked, 7)) == want and rows(lexical.search(again, asked, 7)) == want


def test_lists_hold_each_posting_once(spark):
    chunks = spark.createDataFrame([("b", "red red sea"), ("a", "sea"), ("c", ""), (None, "sea")], "pos string, text string")
    index = lexical.build(chunks)
    assert sorted(map(tuple, index.postings.select("term", "pos", "dl", "tf").collect())) == [("red", "b", 3, 2), ("sea", "a", 1, 1), ("sea", "b", 3, 1)]
    assert index.lists.where("size(pos) = 2").count() <= 1 and plain_tokens("red red sea") == ["red", "red", "sea"]


def test_sparse_vectors_equal_rows(spark):
    vectors = spark.createDataFrame([(1, ["a", "b"], [0.5, 2.0]), (2, ["b", "c"], [-1.0, 1.0]), (3, [], []), (4, ["b", "b"], [1.0, 1.0])], "pos long, terms array<string>, weights array<double>")
    flat = vectors.select("pos", F.explode(F.arrays_zip("terms", "weights")).alias("v")).select("pos", F.col("v.terms").alias("term"), F.col("v.weights").alias("weight"))
    asked = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "c", -2.0)], "query_id long, term string, weight double")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "pos", "score", "rank").collect()))
    assert rows(lexical.sparse(vectors, asked, 3)) == rows(lexical.sparse(flat, asked, 3)) == [(1, 1, 6.5, 1), (1, 2, -3.0, 3), (1, 4, 6.0, 2), (2, 2, -2.0, 1)]


def test_texts_of_a_batch_are_not_all_python_objects():
    """Memory of the automaton's scan is one text and the batch, not the batch twice."""

    class Batch:
        columns = (pa.array([1, 2, 3]), pa.array(["a red sea", "none", "red"]))

        def column(self, i):
            assert i == 0, "the texts as a whole"
            return self.columns[i]

    block = pa.table({"query_id": [7, 8], "text": ["red", "sea"]})
    got = pa.Table.from_batches(verify._holders(block)([Batch()]))
    assert sorted(zip(*got.to_pydict().values())) == [(7, 1), (7, 3), (8, 1)]


def test_codes_are_made_a_slice_at_a_time(monkeypatch):
    asked = pa.table({"query_id": [1], "term": ["a"], "w": [1.0]})
    scan, seen = best.Scan(*best.blocks(asked, 4), 2, [lambda tf, size: tf]), []
    codes = scan._codes
    monkeypatch.setattr(scan, "_codes", lambda terms: seen.append(len(terms)) or codes(terms))
    scan.add(pa.array(range(50)), pa.array([["a", "b"]] * 50), rows=5)
    assert max(seen) == 10 and sum(seen) == 100


def test_a_built_index_is_searched_without_postings(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple", "green pear", "red pear pear", "stone", "sea sand"])], "pos long, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "pear stone"), (3, "nothing")], "query_id long, text string")
    index = lexical.build(chunks)
    index.lists = None
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "pos").collect()))
    assert rows(lexical.search(index, asked, 2)) == [(1, 1, 0), (1, 2, 2), (2, 1, 3), (2, 2, 2)]
    assert rows(lexical.search(index, asked, 3, padded=True))[:3] == [(1, 1, 0), (1, 2, 2), (1, 3, 1)] and rows(lexical.search(index, asked, 3, padded=True))[-3:] == [(3, 1, 0), (3, 2, 1), (3, 3, 2)]
    assert rows(lexical.rm3(index, asked, 2))
