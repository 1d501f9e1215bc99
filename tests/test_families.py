"""Family and process metrics by hand, and both ways of scoring BM25."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, families, lexical, metrics, sampling, verify
from tessera.sources import connect


@pytest.fixture(scope="module")
def run(spark):
    rows = [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 9, "z"), ("a", 2, 1, None), ("b", 1, 1, "z"), ("b", 2, 1, "x"), ("b", 2, 2, "x")]
    return spark.createDataFrame(rows, "method string, query_id int, rank int, doc_id string")


def by(df):
    return {r["method"]: tuple(r)[1:] for r in df.collect()}


def test_chains(spark, run):
    links = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 1, "w"), (2, 0, "x"), (2, 1, "q"), (3, 0, "x")], "query_id int, link int, doc_id string")
    assert by(families.chains(run, links)) == {"a": (0.5, 0.5, 2), "b": (0.25, 0.0, 2)}


def test_bridging_entity(spark, run):
    docs = spark.createDataFrame([("x", "About Insulin."), ("y", "Nothing"), ("z", None)], "doc_id string, text string")
    bridges = spark.createDataFrame([(1, "INSULIN"), (2, "insulin")], "query_id int, entity string")
    assert by(families.bridging(run, bridges, docs)) == {"a": (0.5, 2), "b": (0.5, 2)}


def test_temporal(spark, run):
    years = spark.createDataFrame([("x", 1990), ("y", 2005), ("z", 2020), ("w", None)], "doc_id string, year int")
    gold = spark.createDataFrame([(1, "x"), (1, "z"), (2, "x"), (2, "w")], "query_id int, doc_id string")
    assert by(families.temporal(run, gold, years, k=2)) == {"a": (0.25, 0.25, 2), "b": (0.75, 0.5, 2)}


def test_values_and_negatives(spark, run):
    reported = spark.createDataFrame([(1, 5, "x"), (1, 5, "q"), (1, 7, "y"), (2, 1, "z")], "query_id int, value int, doc_id string")
    assert by(families.values(run, reported)) == {"a": (0.5, 0.5, round(1 / 3, 6), 2), "b": (0.0, 0.0, 0.0, 2)}
    gold = spark.createDataFrame([(1, "x"), (1, "q"), (2, "x")], "query_id int, doc_id string")
    assert by(families.negatives(run, gold, k=2)) == {"a": (0.25, 0.25, 2), "b": (0.5, 0.5, 2)}


def test_constraints_and_tool_use(spark, run):
    docs = spark.createDataFrame([("x", "Mice and rats"), ("y", "humans"), ("z", "MICE")], "doc_id string, text string")
    wanted = spark.createDataFrame([(1, "mice"), (1, "humans"), (1, ""), (2, "rats"), (2, "cats")], "query_id int, value string")
    assert by(families.constraint_coverage(run, wanted, docs, k=2)) == {"a": (0.5, 2), "b": (0.5, 2)}
    trace = spark.createDataFrame([(1, 1, "search", True, "x", True), (1, 2, "refine", False, "y", False), (1, 3, "expand", False, "z", True), (2, 1, "stop", False, None, True)], "task_id int, round int, action string, filtered boolean, doc_id string, final boolean")
    assert sorted(map(tuple, families.tool_use(trace).collect())) == [(1, 0.5, 0.5), (2, 0.0, 0.0)]


def test_both_ways_of_scoring_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    monkeypatch.setattr(lexical, "CHUNK_BLOCK", 33)
    sent = [sorted(map(tuple, x.select("query_id", "pos", "score", "rank").collect())) for x in lexical.ranked(docs, asked, 5, (1.5, 1.2))]
    monkeypatch.setattr(lexical, "MOST_SENT", 0)
    joined = [sorted(map(tuple, x.select("query_id", "pos", "score", "rank").collect())) for x in lexical.ranked(docs, asked, 5, (1.5, 1.2))]
    assert sent == joined and len(sent[0]) == 5 * asked.count()


def test_bm25_of_empty_tables_and_names_as_keys(spark):
    docs = spark.createDataFrame([("a", "red apple"), ("b", None), ("c", "")], "pos string, text string")
    asked = spark.createDataFrame([("q", "apple apple"), ("n", None)], "query_id string, text string")
    assert [(r["query_id"], r["pos"], r["rank"]) for r in lexical.bm25(docs, asked, 3).collect()] == [("q", "a", 1)]
    assert lexical.bm25(docs.limit(0), asked, 3).count() == 0 and lexical.bm25(docs, asked.limit(0), 3).count() == 0


def test_verbatim_items_of_any_length_in_blocks(spark):
    docs = spark.createDataFrame([(1, "an osmosis text"), (2, "xosmosisx a b c"), (3, None), (4, "")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "osmosis"), (2, "a b"), (3, "osmosis"), (4, ""), (5, None), (6, "an osmosis text")], "query_id int, text string")
    want = [(1, 1), (1, 2), (2, 2), (3, 1), (3, 2), (6, 1)]
    assert sorted(map(tuple, verify.verbatim(docs, items).collect())) == want
    assert sorted(map(tuple, verify.verbatim(docs, items, most=5).collect())) == want
    assert verify.verbatim(docs, items.limit(0)).count() == 0


def test_bootstrap_bounds(spark):
    rows = [(m, q, (0.5 if m == "a" else 0.3) + q % 3 / 10) for m in "ab" for q in range(30)]
    scores = spark.createDataFrame(rows, "method string, query_id int, ndcg double")
    r = metrics.bootstrap(scores, "a", "b", "ndcg", rounds=50).first()
    assert (r["mean_difference"], r["low"], r["high"], r["p"], r["rounds"]) == (0.2, 0.2, 0.2, 0.0, 50)
    assert metrics.bootstrap(scores.limit(0), "a", "b", "ndcg").count() == 0


def test_dense_index_and_late_interaction(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "pos long, vector array<double>")
    dense.save(v, str(tmp_path), "m")
    assert [tuple(r) for r in dense.load(spark, str(tmp_path), "m").collect()] == [(1, [0.6, 0.8])]
    q = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "query_id int, vectors array<array<double>>")
    p = spark.createDataFrame([(1, [[2.0, 0.0], [0.0, 3.0]]), (2, [[1.0, 1.0]]), (3, [])], "pos int, vectors array<array<double>>")
    near = q.select("query_id").crossJoin(p.select("pos"))
    assert [tuple(r) for r in dense.late_interaction(near, q, p).orderBy("rank").collect()] == [(1, 1, 5.0, 1), (1, 2, 2.0, 2), (1, 3, 0.0, 3)]


def test_quota_left_and_saved_texts(spark, tmp_path):
    wanted = spark.createDataFrame([("a", 3), ("b", 2)], "family string, n int")
    assert sorted(map(tuple, sampling.quota_left(wanted, spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "family string")).collect())) == [("a", 2), ("b", 0)]
    found = spark.createDataFrame([("p1", "<x>\n<y/>"), ("p2", None), ("p3", "z")], "pmcid string, payload string")
    log = connect.save_texts(found, spark.createDataFrame([("p3",)], "pmcid string"), "pmcid", str(tmp_path / "t"))
    assert sorted(map(tuple, log.collect())) == [("p1", "saved", 8), ("p2", "missing", 0), ("p3", "exists", 0)]
    assert [p.name for p in sorted((tmp_path / "t" / "xml").iterdir()) if p.is_dir()] == ["pmcid=p1"]
    assert connect.lookup_path("doi", F.lit("https://doi.org/10.1/x")) is not None
