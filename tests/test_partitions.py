"""A task's share of rows stays the same with any input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import store
from tessera.operators import agent, graph


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(store, "MOST_ROWS", 100)


def test_expanded_links_are_spread_by_their_number(spark, few):
    edges = spark.range(900).select(F.concat(F.lit("o"), F.col("id") % 90).alias("src"), F.concat(F.lit("p"), F.col("id") % 300).alias("dst"))
    got = graph.expand(edges.select(F.col("dst").alias("doc_id")), edges, "cited_by")
    assert got.rdd.getNumPartitions() == 18 and got.count() == 900


def test_fused_rollouts_are_spread_by_their_number(spark, few):
    runs = spark.range(900).select((F.col("id") % 90).alias("query_id"), (F.col("id") % 4).alias("rollout"), (F.col("id") % 45).alias("doc_id"), (F.col("id") % 7 + 1).alias("rank"))
    got = agent.fused_rollouts(runs)
    assert got.rdd.getNumPartitions() == 9
    assert got.count() == runs.select("query_id", "doc_id").distinct().count()
