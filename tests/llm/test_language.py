from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np

from tessera.llm import language as L
from tessera.llm import queries


def plain_counts(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        w = f" {w} "
        for n in L.ORDERS:
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g != " " and " " not in g[1:-1]:
                    out[g] += 1
    return out


def test_counts_equal_plain_ones():
    texts = ["The cat, the hat.", "", None, "Äö 1st ñandú", "a"]
    doc, _, count = L.counts(texts)
    for i, t in enumerate(texts):
        assert sorted(count[doc == i]) == sorted(plain_counts(t or "").values())


def test_distance_is_the_sum_of_places():
    known = L.assemble({"x": [], "y": []}, 5)
    doc, rank, gram = L.profiles(["abc abd abe"], 5)
    own = gram.tolist()
    known = L.assemble({"same": own, "turned": own[::-1], "none": []}, 5)
    d, some = L.distances(["abc abd abe"], known)
    assert some[0]
    assert d[0].tolist() == [25, 0, sum(abs(2 * i - 4) for i in range(5))]  # none, same, turned


def test_equal_counts_rank_by_hash_and_equal_distances_by_name():
    _, rank, gram = L.profiles(["ab"], 100)
    assert gram.tolist() == sorted(gram.tolist()) and len(gram) == 8
    both = L.assemble({"b": gram.tolist(), "a": gram.tolist()}, 100)
    assert both.names[int(np.argsort(L.distances(["ab"], both)[0][0], kind="stable")[0])] == "a"


def test_counts_past_the_key_bits_rank_by_count(monkeypatch):
    texts = ["abc abd " * 40 + "xyz " * 50, None, "some more words"]
    want = [x.tolist() for x in L.profiles(texts, 30)]
    monkeypatch.setattr(L, "_COUNT_BITS", 4)
    assert [x.tolist() for x in L.profiles(texts, 30)] == want


def test_whole_table_against_plain_counts_and_ranks(spark, sf):
    """Profiles, places and the nearest language by loops, on all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    md5 = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    hashed = {}

    def top(c):
        for g in c:
            if g not in hashed:
                hashed[g] = gram_hash(g)
        return sorted(c, key=lambda g: (-c[g], hashed[g]))[: L.LENGTH]

    by = {i: plain_counts(t or "") for i, t in zip(docs.doc_id, docs.text)}
    known = {}
    for lang, part in docs.groupby("lang"):
        chosen = sorted(part.doc_id, key=md5)[: L.MOST_LABELLED]
        known[lang] = {g: r for r, g in enumerate(top(sum((by[i] for i in chosen), Counter())))}
    got = {r["doc_id"]: (r["language"], r["distance"]) for r in queries.op2_language_id(spark, sf).collect()}
    for i, c in by.items():
        own = top(c)
        far = sorted((sum(abs(places[g] - r) if g in places else L.LENGTH for r, g in enumerate(own)), lang) for lang, places in known.items())
        assert got[i] == ((far[0][1], far[0][0]) if own else (None, None))


def gram_hash(g):
    h = ord(g[0]) + 1
    for c in g[1:]:
        h = (h * int(L._MULTIPLIER) + ord(c)) % 2**64
    h = (h + len(g)) % 2**64
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * m % 2**64
    return (h ^ (h >> 33)) >> (64 - L._HASH_BITS)


def test_awkward_rows(spark, awkward):
    known = L.fit_on(awkward)
    rows = L.identify(awkward, known).collect()
    assert len(rows) == awkward.count()
    assert {r["doc_id"]: r["language"] for r in rows} == {1: None, 2: None, 3: None, 4: "en", 5: "en", 6: "en", None: "en", 7: None}
    assert all(r["margin"] is None for r in rows)  # one language only


def test_empty_table_and_no_labels(spark, make_docs):
    assert L.identify(make_docs([]), L.fit_on(make_docs([]))).count() == 0
    one = L.identify(make_docs([(1, "words")]), L.assemble({})).collect()
    assert one[0]["language"] is None and one[0]["distance"] is None


def test_query_is_right_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = L.fit_on(docs.where("doc_id % 2 = 0"))
    got = L.identify(docs.where("doc_id % 2 = 1"), known).toPandas().merge(docs.toPandas(), on="doc_id")
    long = got[got.n_chars > 60]
    assert np.mean(long.language == long.lang) > 0.97
    assert queries.op2_language_id(spark, sf).count() == docs.count()
