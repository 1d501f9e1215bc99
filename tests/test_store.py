from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from tessera import store


def test_written_tables_are_read_back_and_dropped(spark):
    table = store.written(spark.range(5))
    path = table._written_path.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    store.drop(table)
    assert not os.path.isdir(path)
    store.drop(spark.range(1))  # not a written one


def test_size_counts_rows_and_entries_and_bounds_the_broadcast(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, None)], "a long, b array<long>")
    assert store.size(df) == 192 and store.size(df, ("b",)) == 240 and store.size(df.limit(0)) == 0
    hinted = lambda most: "ResolvedHint" in store.sent(df, most, ("b",))._jdf.queryExecution().analyzed().toString()
    assert hinted(240) and not hinted(239)


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        conf = {}
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            store.shared_folder(session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert store.shared_folder(session(master)).startswith("file://")
