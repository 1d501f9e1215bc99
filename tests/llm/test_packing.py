from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P
from tessera.llm import queries, token_count


def plain(lengths, capacity):
    """One piece at a time: contents of each bin, sorted."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    bins = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), None)
        if b is not None:
            large.remove(b)
        bins.append([a] if b is None else [a, b])
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [x for x in bins if sum(x) + s <= capacity]
        if fits:
            min(fits, key=lambda x: capacity - sum(x)).append(s)
        else:
            bins.append([s])
    return Counter(tuple(sorted(x)) for x in bins)


def contents(runs, capacity):
    bins = defaultdict(list)
    for length, _, pieces, m, first, offset in runs:
        for i in range(pieces):
            bins[first + i // m].append((offset + i % m * length, length))
    for got in bins.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at  # no gap, no overlap
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in got) <= 2
    assert sorted(bins) == list(range(len(bins)))
    return Counter(tuple(sorted(n for _, n in x)) for x in bins.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plan_equals_one_piece_at_a_time(lengths):
    got, want = contents(P.plan(Counter(lengths), 24), 24), plain(lengths, 24)
    assert sum(got.values()) == sum(want.values())
    assert sorted(map(sum, got.elements())) == sorted(map(sum, want.elements()))


def _bins(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        if r["bin_id"] is not None:
            by[r["bin_id"]].append((r["bin_offset"], r["n_tokens"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return by


def test_awkward_rows(spark, awkward):
    rows = P.pack(awkward, 1000).collect()
    _bins(rows, 1000)
    size = dict(token_count.token_counts(awkward).toPandas().itertuples(index=False))
    by = Counter(r["doc_id"] for r in rows)
    assert size[4] > 90_000 and by[4] == -(-size[4] // 1000) and by[5] == 2 and by[1] == by[2] == by[3] == by[None] == 1
    assert {r["doc_id"] for r in rows if r["bin_id"] is None} == {1, 2}
    total = Counter()
    for r in rows:
        assert r["start"] == 1000 * r["piece"]
        total[r["doc_id"]] += r["n_tokens"]
    assert (total[1], total[2], total[3], total[4], total[5], total[6]) == (0, 0, size[3], size[4], 2 * size[5], size[6])


def test_empty_table(spark, make_docs):
    assert P.pack(make_docs([])).count() == 0
    assert [r["bin_id"] for r in P.pack(make_docs([(1, "")])).collect()] == [None]


def test_query_places_every_token(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    _bins(rows, P.CAPACITY)
    want = Counter()
    lengths = []
    tokens = token_count.counts(docs.text.tolist(), token_count.read_vocabulary()).tolist()
    for i, n in zip(docs.doc_id, tokens):
        want[i] += n
        lengths += [min(P.CAPACITY, n - s) for s in range(0, n, P.CAPACITY)]
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
    assert len({r["bin_id"] for r in rows if r["bin_id"] is not None}) == sum(plain(lengths, P.CAPACITY).values())
