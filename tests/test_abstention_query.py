from __future__ import annotations

import inspect
import random

import pytest

from tessera.operators import abstention
from tessera.plans import queries


def test_the_registered_queries_boost_as_long_as_the_operator(monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_features", lambda spark, d: "features")
    for name in ("out_of_fold", "importances"):
        assert inspect.signature(getattr(abstention, name)).parameters["trees"].default == 100
        monkeypatch.setattr(abstention, name, lambda data, **how: asked.append(how) or data)
    assert queries.gbt_abstention(None, "") == queries.gbt_importance(None, "") == "features"
    assert asked == [{}, {}]


def test_scores_are_out_of_fold_and_importances_sum_to_one(spark):
    """One feature tells the labels apart, the others are noise."""
    rng = random.Random(4)
    rows = [(i, *(float(i % 2 == 0) if f == "query_length" else rng.random() for f in abstention.FEATURES), int(i % 2 == 0)) for i in range(80)]
    data = spark.createDataFrame(rows, "query_id long, " + ", ".join(f"{f} double" for f in abstention.FEATURES) + ", label int")
    scores, weights = abstention.cross_validated(data, k=2, trees=3)
    got = {r["query_id"]: (r["label"], r["score"]) for r in scores.collect()}
    assert len(got) == 80 and all((s > 0.5) == (y == 1) for y, s in got.values())
    assert next(iter(weights)) == "query_length" and sum(weights.values()) == pytest.approx(1)
    assert abstention.auroc(scores).first()["auroc"] == 1.0
