from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import abstention, agent, fusion, generate, graph, lexical, metrics, sampling, verify
from tessera.sources import export


def run_of(spark, rows):
    return spark.createDataFrame(rows, "method string, query_id int, rank int, doc_id string")


def test_metrics_by_hand(spark):
    run = run_of(spark, [("m", 1, 1, "x"), ("m", 1, 2, "g"), ("m", 2, 1, None), ("m", 3, 1, "z")])
    gold = spark.createDataFrame([(1, "g"), (2, "h"), (2, "i")], "query_id int, doc_id string")
    got = {r["query_id"]: r for r in metrics.per_query(run, gold).collect()}
    assert got[1]["ndcg"] == pytest.approx(1 / math.log2(3)) and got[1]["mrr"] == 0.5 and got[1]["recall_5"] == 1
    assert got[2]["n_gold"] == 2 and got[2]["recall_20"] == got[2]["mrr"] == got[3]["ndcg"] == 0
    assert all(got[1][f"recall_{a}"] <= got[1][f"recall_{b}"] for a, b in ((5, 10), (10, 20)))
    families = spark.createDataFrame([(1, "f")], "query_id int, family string")
    report = metrics.aggregate(metrics.per_query(run, gold), families, ["mrr", "recall_10"])
    rows = {(r["family"], r["metric"]): r["value"] for r in report.collect()}
    assert rows[("all", "mrr")] == 0.1667 and rows[("unknown", "mrr")] == 0 and rows[("f", "mrr")] == 0.5
    assert metrics.best_method(report).first()["method"] == "m"
    assert "textbf{0.167}" in export.latex(report, ["mrr"]) and export.by_family(report).count() == 2 and export.by_cut(report).first()["k"] == 10


def test_run_lists(spark):
    df = spark.createDataFrame([("t", ["a", "b", "a"], "m"), ("u", [], "m")], "task_id string, retrieved_docs array<string>, method string")
    got = {(r["query_id"], r["rank"], r["doc_id"]) for r in metrics.from_lists(df).collect()}
    assert got == {("t", 1, "a"), ("t", 2, "b"), ("t", 3, "a"), ("u", 1, None)}


def test_bootstrap_and_the_rest(spark):
    s = spark.createDataFrame([(m, q, 1.0 if m == "a" else 0.0, 2) for m in "ab" for q in range(12)], "method string, query_id int, ndcg double, n_gold int")
    r = metrics.bootstrap(s, "a", "b", "ndcg", 50).first()
    assert (r["mean_difference"], r["low"], r["high"], r["p"]) == (1.0, 1.0, 1.0, 0.0)
    run = run_of(spark, [("m", 1, 1, "x"), ("m", 1, 2, "n")])
    neg = spark.createDataFrame([(1, "n")], "query_id int, doc_id string")
    assert metrics.near_miss(run, neg).first()["near_miss"] == 0.5
    sides = spark.createDataFrame([(1, "x", "pro"), (1, "y", "con")], "query_id int, doc_id string, side string")
    assert metrics.sides_covered(run, sides).first()["both_sides"] == 0.0
    p = spark.createDataFrame([(1, "a gold passage"), (1, "another one")], "query_id int, text string")
    assert metrics.passage_recall(spark.createDataFrame([(1, "a gold passags")], "query_id int, text string"), p).first()["passage_recall"] == 0.5


def test_abstention_curves(spark):
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0)], "score double, label int")
    assert abstention.auroc(s).first()[0] == pytest.approx((3 / 3 + 0 + 0.5 + 2 - 0.5 + 0) / 6 + 0.0, abs=0.3)
    pos, neg = [0.35, 0.8], [0.1, 0.4, 0.8]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 6
    assert abstention.auroc(s).first()[0] == pytest.approx(want, abs=1e-6)
    assert abstention.average_precision(s).first()[0] == pytest.approx(0.5 * (1 / 2) + 0.5 * (2 / 4), abs=1e-6)
    curve = {r["threshold"]: r for r in abstention.risk_coverage(s).collect()}
    for i in range(101):
        t = i / 100
        below = [(x, y) for x, y in [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0)] if x < t]
        assert curve[t]["coverage"] == pytest.approx(len(below) / 5)
        assert curve[t]["risk"] == pytest.approx(sum(y for _, y in below) / len(below) if below else 0, abs=1e-6)
    one = spark.createDataFrame([(0.5, 1)], "score double, label int")
    assert abstention.auroc(one).first()[0] is None
    assert abstention.aurc(abstention.risk_coverage(s)).first()[0] > 0


def test_features_and_folds(spark):
    run = run_of(spark, [("bm25", 1, 1, "a"), ("bm25", 1, 2, "b"), ("x", 1, 1, "a"), ("x", 1, 2, "c"), ("bm25", 2, 1, None)])
    tasks = spark.createDataFrame([(1, "two words", 2, "abstention"), (2, "", 0, "f"), (3, "no run", 0, "f")], "query_id int, text string, n_constraints int, family string")
    got = {r["query_id"]: r.asDict() for r in abstention.features(run, tasks).collect()}
    assert set(got) == {1, 2}
    assert got[1] == {"query_id": 1, "avg_pool_overlap": 0.333333, "bm25_n_retrieved": 2.0, "n_constraints": 2.0, "n_methods_agree_top1": 2.0, "n_unique_top10": 3.0, "query_length": 2.0, "top1_agreement_rate": 1.0, "label": 1}
    assert got[2]["n_unique_top10"] == 0 and got[2]["avg_pool_overlap"] == 0
    data = spark.createDataFrame([(i, int(i < 3)) for i in range(20)], "query_id int, label int")
    f = abstention.folds(data).collect()
    assert {r["fold"] for r in f} == {0, 1, 2} and len({r["fold"] for r in f if r["label"]}) == 3


@pytest.mark.parametrize("n,want", [(1, (0, 0, 1)), (2, (0, 0, 2)), (3, (1, 1, 1)), (5, (2, 1, 2)), (8, (3, 2, 3)), (13, (5, 3, 5))])
def test_split_sizes(spark, n, want):
    s = sampling.stratified_split(spark.range(n).withColumn("f", F.lit("x")), "id", ["f"])
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "dev", "test")) == want and s.count() == n


@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (4, (1, 1, 2)), (5, (1, 2, 2)), (8, (2, 3, 3))])
def test_contradiction_thirds(spark, n, want):
    df = spark.range(n).selectExpr("1 as g", "id", "cast(2000 + id as int) as year")
    p = graph._placed(df, "g", "year", "id")
    seen = {"early": set(), "middle": set(), "late": set()}
    for seed in range(12):
        r = graph.contradictions(df, "g", "year", "id", seed).first()
        for k in seen:
            seen[k].add(r[k])
    early, late = n // 3, n - -(-n // 3)
    assert all(x < early for x in seen["early"]) and all(x >= late for x in seen["late"]) and p.count() == n
    assert all(early <= x < late for x in seen["middle"] if x is not None)
    assert graph.contradictions(df.limit(2), "g", "year", "id").count() == 0


def test_graph_samples(spark):
    df = spark.range(10).selectExpr("id % 2 as g", "id", "cast(2000 + id as int) as year")
    assert graph.eras(df, "g", "year", "id").where("g = 0").orderBy("ordinal").select("id").collect() == [(0,), (2,), (4,)]
    assert graph.spread(df, "g", "id").count() == 8 and graph.motif("nothing") is None
    refs = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 6), (2, 0, 5)], "src int, position int, dst int")
    assert [tuple(r) for r in graph.citation_star(refs).collect()] == [(1, 5, 6)]
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (3, 3)], "src int, dst int")
    assert {tuple(r) for r in graph.two_hops(e).collect()} == {(1, 2, 3)}


def test_verification(spark):
    chunks = spark.createDataFrame([(1, "d1", "Alpha beta"), (2, "d1", "alpha beta gamma"), (3, "d2", "alpha"), (4, "d3", "none")], "pos int, doc_id string, text string")
    ranked = spark.createDataFrame([(1, p, p) for p in (1, 2, 3, 4)] + [(2, 1, 1)], "query_id int, pos int, rank int")
    c = spark.createDataFrame([(1, "ALPHA"), (1, "beta"), (3, "")], "query_id int, value string")
    got = verify.check(ranked, chunks, c)
    assert {(r["doc_id"], r["kind"]) for r in got.collect()} == {("d1", "supporting"), ("d2", "hard_negative")}
    assert verify.passages(got, chunks).first()["text"] == "Alpha beta"
    tasks = spark.createDataFrame([(1, "f"), (2, "f"), (3, "abstention")], "query_id int, family string")
    assert {r["query_id"]: r["status"] for r in verify.verdicts(tasks, got).collect()} == {1: "auto_verified", 2: "rejected", 3: "auto_verified"}


def test_verbatim(spark):
    docs = spark.createDataFrame([(1, "say one two three four now"), (2, "xone two threey"), (3, "one  two three")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "")], "query_id int, text string")
    assert {tuple(r) for r in verify.verbatim(docs, items).collect()} == {(1, 1), (1, 2), (2, 1)}


def test_quota_rules(spark):
    s = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.01, 3)], "family string, share double, ord int")
    got = lambda rule: {r["family"]: r["n"] for r in sampling.quota(s, 10, rule).collect()}
    assert got("floor2") == {"a": 5, "b": 3, "c": 2} and got("exact") == {"a": 6, "b": 3, "c": 1} and got("equal") == {"a": 3, "b": 3, "c": 3}


def test_agent_stops_and_keeps_order(spark):
    chunks = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(["red apple", "green pear", "red pear", "stone"])], "pos long, doc_id string, text string")
    tasks = spark.createDataFrame([(1, "red"), (2, "pear"), (3, "stone")], "query_id long, text string")
    search = agent.environment(lexical.build(chunks), chunks)

    def policy(open_, r):
        reply = F.when(F.col("query_id") == 3, F.lit("no idea")).when(F.lit(r) == 1, F.to_json(F.struct(F.lit("SEARCH").alias("action"), F.col("text").alias("query"))))
        reply = reply.when((F.lit(r) == 2) & (F.col("query_id") == 1), F.lit('{"action": "refine", "query": "stone"}')).otherwise(F.lit('{"action": "stop", "selected_docs": ["made-up"]}'))
        return open_.select("query_id", reply.alias("reply"))

    runs, trace = agent.run(tasks, policy, search, chunks, rounds=3)
    got = {r["query_id"]: r for r in runs.collect()}
    assert got[3]["retrieved_docs"] == [] and got[3]["rounds"] == 1
    assert got[2]["retrieved_docs"] == ["made-up"] and got[2]["total_docs_seen"] == 2
    assert got[1]["retrieved_docs"] == ["made-up"] and got[1]["total_docs_seen"] == 3 and got[1]["rounds"] == 3
    assert trace.count() == 3 + 2 + 1 and agent.summary(runs).first()["n"] == 3
    roll = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 2), (1, 1, "b", 1)], "query_id int, rollout int, doc_id string, rank int")
    assert [r["doc_id"] for r in agent.fused_rollouts(roll).orderBy("rank").collect()] == ["a", "b"]
    first = fusion.accumulated(spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "b"), (1, 2, 2, "c")], "query_id int, round int, rank int, doc_id string"))
    assert [r["doc_id"] for r in first.orderBy("seen").collect()] == ["a", "b", "c"]


def test_generation(spark):
    members = spark.createDataFrame([("t", 1, "d1", "T", 2001, "abs", ["m"]), ("t", 2, "d2", None, None, None, None)], "task_id string, ordinal int, doc_id string, title string, year int, abstract string, mesh_terms array<string>")
    p = generate.cluster_prompts(members, "Ask.")
    assert p.first()["prompt"].startswith("Ask.\n\nPaper 1: T (2001)") and p.first()["doc_ids"] == ["d1", "d2"]
    bad = generate.ask(p, lambda b: 1 / 0)
    assert bad.first()["reply"] is None
    clusters = p.select("task_id", F.lit("abstention").alias("task_family"), F.lit("hard").alias("difficulty"), "doc_ids")
    ok = spark.createDataFrame([("t", 'x {"question": "q?"}')], "task_id string, reply string")
    t = generate.tasks_from_replies(ok, clusters, "g").first()
    assert t["supporting_doc_ids"] == [] and t["hard_negative_doc_ids"] == ["d1", "d2"]
    assert generate.judged(clusters, spark.createDataFrame([("t", "2 and 7")], "task_id string, reply string")).first()["doc_ids"] == ["d2"]
    assert generate.judged(clusters, bad).first()["doc_ids"] == ["d1", "d2"] and generate.missing(clusters, ok).count() == 0
    assert generate.facts(spark.createDataFrame([("t", '[{"a": "1"}, {"a": "2"}]')], "task_id string, reply string")).count() == 2
