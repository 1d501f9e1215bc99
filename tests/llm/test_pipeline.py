from __future__ import annotations

import random

import pyarrow as pa
import pytest

import corpus_pipeline as C
from tessera import store
from tessera.llm import decontaminate, near_dedup, packing, quality, scratch, toxicity


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality classifier", "near duplicates", "benchmark decontamination", "best-fit packing"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        docs = scratch.table(stage(spark, docs, sf))
        out.append(docs)
    return out


def test_each_decision_takes_effect(spark, sf, stages):
    labels, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "benchmark"))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in stages]
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns
    bad = {r["doc_id"] for r in toxicity.score(stages[0], toxicity.fit_on(stages[0], labels)).collect() if r["toxic"]}
    assert ids[1] == ids[0] - bad and bad
    low = {r["doc_id"] for r in quality.score(stages[1], quality.fit_on(stages[1], labels)).collect() if not r["keep"]}
    assert ids[2] == ids[1] - low and low
    gone = {r["doc_id"] for r in near_dedup.near_dedup(stages[2]).collect() if not r["kept"]}
    assert ids[3] == ids[2] - gone and gone
    leaks = {r["doc_id"] for r in decontaminate.contaminated(stages[3], bench).collect()}
    assert ids[4] == ids[3] - leaks and leaks
    assert ids[5] == ids[4]
    assert stages[5].columns == packing.pack(stages[4]).columns


def test_run_is_the_stages(spark, sf, stages):
    assert C.run(spark, sf).count() == stages[-1].count()


def test_stages_take_awkward_and_empty_tables(spark, sf, awkward, make_docs):
    docs, kept = awkward, []
    for _, stage in C.STAGES:
        docs = scratch.table(stage(spark, docs, sf))
        kept.append(sorted((r["doc_id"] for r in docs.select("doc_id").distinct().collect()), key=str))
    assert kept[:2] == [[1, 2, 3, 4, 5, 6, 7, None]] * 2  # no label has one of these texts to learn from
    assert kept[2:] == [[1, 2, 3, 4, 5, 7, None]] * 3
    rows = docs.collect()
    assert {r["doc_id"] for r in rows if r["bin_id"] is None} == {1, 2} and sum(r["doc_id"] == 5 for r in rows) == 1
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 4) > 90_000
    docs = make_docs([])
    for _, stage in C.STAGES:
        docs = scratch.table(stage(spark, docs, sf))
        assert docs.count() == 0


def test_run_drops_what_later_stages_do_not_read(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(C.scratch, "table", lambda df, table=scratch.table: made.append(table(df)) or made[-1])
    out = C.run(spark, sf)
    stages = [t for t in made if t.columns == spark.read.parquet(f"{sf}/documents.parquet").columns]
    assert out.count() and len(stages) == 4 and not any(t._written_path in store._written for t in stages)


def test_near_copies_stage_misses_no_link(spark, sf, make_docs):
    """Of pairs of ten words with three changed, every second one goes."""
    rng = random.Random(29)
    rows = []
    for i in range(0, 200, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(10)]
        copy = list(base)
        for at in rng.sample(range(10), 3):
            copy[at] = f"z{rng.randrange(10**9)}"
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
    kept = C.near_copies_out(spark, make_docs(rows), sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 200, 2))


def test_stages_set_small_batches_and_run_resets_them(spark, sf, make_docs):
    """Ten MB of texts after each stage: no batch holds much more than its bound."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, b.column(0).to_pylist()))])], names=["n"])

    texts = spark.range(40, numPartitions=1).selectExpr("repeat('word ', 50000) text")
    try:
        for _, stage in C.STAGES:
            spark.conf.set(setting, before)
            stage(spark, make_docs([]), sf)
            got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(got) == 10_000_000 and max(got) <= (4 << 20) + 250_000
        spark.conf.set(setting, "48m")
        C.run(spark, sf)
        assert spark.conf.get(setting) == "48m"
    finally:
        spark.conf.set(setting, before)
