from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, filters, fusion, graph, lexical
from tessera.plans.engine import EvidenceEngine
from test_text import plain_tokens


def plain_bm25(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = [plain_tokens(t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    tf = [Counter(d) for d in docs]
    return [sum(idf.get(w, 0) * t[w] * (k1 + 1) / (t[w] + k1 * (1 - b + b * len(d) / avg)) for w in plain_tokens(query)) for t, d in zip(tf, docs)]


TEXTS = ["red apple tree", "green apple apple pie", "blue sky and sea", "the sea the sea", "apple sea red red", ""]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, f"d{i // 2}", t, "abstract" if i % 2 == 0 else "body") for i, t in enumerate(TEXTS)], "pos long, doc_id string, text string, section_type string").withColumn("section_heading", F.lit(""))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "red apple apple"), (2, "sea"), (3, "unknown words"), (4, "")], "query_id long, text string")


def test_bm25_equals_plain_scores(spark, chunks, asked):
    got = {(r["query_id"], r["pos"]): r["score"] for r in lexical.bm25(chunks, asked, 10).collect()}
    for q, text in ((1, "red apple apple"), (2, "sea")):
        for i, s in enumerate(plain_bm25(TEXTS, text)):
            assert got.get((q, i), 0.0) == pytest.approx(s, abs=1e-6)
    assert not any(q in (3, 4) for q, _ in got)


def test_padding_fills_lists_in_corpus_order(spark, chunks, asked):
    rows = lexical.bm25(chunks, asked, 4, padded=True).orderBy("query_id", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r["pos"])
    for q, text in ((1, "red apple apple"), (2, "sea"), (3, "unknown words"), (4, "")):
        s = [round(x, 6) for x in plain_bm25(TEXTS, text)]
        assert by[q] == sorted(range(len(s)), key=lambda i: -s[i])[:4], q


def test_index_survives_saving(spark, chunks, asked, tmp_path):
    index = lexical.build(chunks)
    index.save(str(tmp_path))
    again = lexical.Index.load(spark, str(tmp_path))
    a, b = (lexical.search(x, asked, 3).collect() for x in (index, again))
    assert sorted(a) == sorted(b)
    assert lexical.rm3(again, asked, 3).where("query_id = 1").count() > 0


def test_grep_in_order(spark, chunks):
    assert [r["pos"] for r in lexical.grep(chunks, "APPLE", 2).collect()] == [0, 1]


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "query_id int, doc_id string, rank int") for x in ([(1, "a", 1), (1, "b", 2)], [(1, "a", 1), (1, "c", 2)])]
    rows = fusion.reciprocal_rank(lists, "doc_id", 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["a", "b", "c"] and rows[0]["score"] == pytest.approx(2 / 61, abs=1e-9)
    turned = fusion.reciprocal_rank(lists[::-1], "doc_id", 5).orderBy("rank").collect()
    assert {r["doc_id"]: r["score"] for r in turned} == {r["doc_id"]: r["score"] for r in rows}
    d = fusion.first_per_document(spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3)], "query_id int, doc_id string, rank int"), 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in d] == [("x", 1), ("y", 2)]


def test_rerank_and_pool(spark, chunks, asked):
    ranked = lexical.bm25(chunks, asked, 10)
    got = fusion.rerank(ranked, chunks, asked, lambda q, p: [-len(x) for x in p]).where("query_id = 1").orderBy("rank").collect()
    assert [len(TEXTS[r["pos"]]) for r in got] == sorted(len(TEXTS[r["pos"]]) for r in got)
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 30)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "a")], "query_id int, doc_id string")
    assert fusion.pool([run, run], gold, 40).collect()[0]["doc_id"] == "b" and fusion.pool([run], gold, 20).count() == 0


def test_dense_equals_numpy_over_many_blocks(spark, sf):
    df = pd.read_parquet(f"{sf}/embeddings.parquet").head(90)
    x = np.stack(df.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = spark.createDataFrame(df[["vec_id", "embedding"]].assign(embedding=[v.tolist() for v in df.embedding]))
    got = dense.search(s.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), s.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, exclude_self=True, block=25).toPandas()
    score = np.round(x @ x.T, 6)
    np.fill_diagonal(score, -9)
    for q, part in got.groupby("query_id"):
        i = df.vec_id.tolist().index(q)
        want = df.vec_id.to_numpy()[np.lexsort((df.vec_id, -score[i]))[:5]]
        assert part.sort_values("rank").pos.tolist() == want.tolist()


def test_zero_vectors_and_encoding(spark):
    z = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "pos long, vector array<double>")
    assert [r[0] for r in z.select(dense.normalised("vector")).collect()] == [[0.0, 0.0], [0.6, 0.8], None]
    c = spark.createDataFrame([(1, "ab"), (2, None)], "pos long, text string")
    assert {r["pos"]: r["vector"] for r in dense.encode(c, lambda t: [[len(x), 0] for x in t]).collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("d0", "Rats generate", "an abstract", 2001, ["Mice", "Mice/genetics"], ["Review"], "https://openalex.org/W1", ["https://openalex.org/W2", "W3", "W9"]), ("d1", "B", "of humans", None, ["Humans"], [], "W2", ["W1"]), ("d2", "C", None, 2010, None, None, "W3", [])]
    return spark.createDataFrame(rows, "doc_id string, title string, abstract string, year int, mesh_terms array<string>, publication_types array<string>, openalex_id string, referenced_work_ids array<string>")


def test_metadata_filters(spark, docs):
    found = spark.createDataFrame([("d0", 1), ("d1", 2), ("d2", 3), ("zz", 4)], "doc_id string, rank int")
    kept = lambda **how: sorted(r["doc_id"] for r in filters.by_metadata(found, docs, **how).collect())
    assert kept() == ["d0", "d1", "d2", "zz"] and kept(year_min=0) == ["d0", "d1", "d2", "zz"]
    assert kept(year_min=2000) == ["d0", "d2"] and kept(year_max=2005) == ["d0"]
    assert kept(organisms=["rat"]) == ["d0"] and kept(organisms=["HUMAN", "rat"]) == ["d0", "d1"]
    assert kept(mesh_terms=["mice"]) == ["d0"] and kept(mesh_terms=["mic"]) == [] and kept(publication_types=["review"], year_max=1999) == []
    both = filters.by_metadata(filters.by_metadata(found, docs, year_min=2000), docs, organisms=["rat"])
    assert both.count() == len(kept(year_min=2000, organisms=["rat"]))


def test_confidence(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    rows = [(1, r, s) for r, s in enumerate((5.0, 4.9, 4.8, 4.5, 4.0), 1)] + [(2, r, s) for r, s in enumerate((6.0, 5.0, 5.0, 5.0, 5.0), 1)] + [(3, 1, 30.0)]
    got = {r["query_id"]: r for r in filters.confidence(spark.createDataFrame(rows, "query_id int, rank int, score double"), q).collect()}
    assert (got[1]["confidence"], got[1]["gap"], got[1]["abstain"]) == (0.25, 1.0, True)
    assert got[2]["confidence"] == 0.3 and not got[2]["abstain"]
    assert got[3]["confidence"] == 1.0 and got[3]["gap"] == 0 and got[4]["abstain"]


def test_engine(spark, chunks, docs, asked):
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(6)], "pos long, vector array<double>")
    e = EvidenceEngine(docs, chunks, {"m": vectors})
    q = asked.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    assert e.search_dense(q, "none").count() == 0 and e.search_hybrid(q).where("query_id = 3").count() == 0
    fused = e.search_hybrid(q, "m", 3)
    assert fused.where("query_id = 3").count() == 3
    assert {r["neighbour"] for r in e.expand_citations(docs.where("doc_id = 'd0'")).collect()} == {"d1", "d2"}
    assert e.expand_citations(docs.where("doc_id = 'd2'"), "references").count() == 0
    assert e.grep_corpus("sky").count() == 1 and len(e.read_document(docs.where("doc_id = 'd0'")).first()["chunks"]) == 1
    assert e.tool("grep_corpus") is not None and e.tool("__init__") is None
    assert e.filter_metadata(fused, year_min=2005).select("doc_id").distinct().collect() == [("d2",)]
    with pytest.raises(ValueError):
        e.expand_citations(docs, "sideways")


def test_expansion_is_capped(spark):
    e = spark.createDataFrame([("a", f"b{i:02}") for i in range(60)] + [("a", "a")], "src string, dst string")
    assert graph.expand(spark.createDataFrame([("a",)], "doc_id string"), e).count() == 50


def test_dense_moves_each_side_as_often_as_the_cores_ask(spark, monkeypatch):
    """Blocks grow with the rows up to their bytes, so the copies of a row don't."""
    assert dense._grid(600_000, 600_000, 12, 131_072) == (5, 5) and dense._grid(60_000, 60_000, 12, 131_072) == (5, 5)
    assert dense._grid(3_000_000, 60_000, 12, 131_072)[1] == 1 and dense._grid(100, 100, 12, 131_072) == (1, 1)
    assert dense._grid(1_000_000, 1_000_000, 4, 10_000) == (100, 100)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (9000, 4)).astype(float)  # many equal scores, over two runs of 4,096 entries
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, vector array<double>")
    got = dense.search(e, e.where("pos % 300 = 7").withColumnRenamed("pos", "query_id"), 5, block=9000).toPandas()
    unit = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    for q, part in got.groupby("query_id"):
        s = np.round(unit @ unit[q], 6)
        assert part.sort_values("rank").pos.tolist() == np.lexsort((np.arange(9000), -s))[:5].tolist()
