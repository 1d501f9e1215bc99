from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from tessera.llm import labelled, queries
from tessera.llm import quality as Q
from tessera.llm import toxicity as X
from tessera.llm import url_filter as U


@pytest.fixture(scope="module")
def halves():
    d = "/root/testdata/sf0.1"
    m = pd.read_parquet(f"{d}/documents.parquet").merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id").sort_values("doc_id").reset_index(drop=True)
    return m[m.index % 2 == 0], m[m.index % 2 == 1]


def test_ngrams_equal_plain_ones():
    texts = ["Abc de", "", None, "x-y abcdefg"]
    doc, bucket = X.ngrams(texts)
    for i, t in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        want = {w[j : j + n] for w in (f" {w} " for w in words) for n in X.ORDERS for j in range(len(w) - n + 1)}
        assert (doc == i).sum() == len(want)  # no collisions among so few


def test_toxicity_on_held_out_labels(spark, halves):
    a, b = halves
    model = X.fit_on(spark.createDataFrame(a[["doc_id", "text"]]), spark.createDataFrame(a[["doc_id", "toxic"]]))
    said = X.scores(b.text.tolist(), model) >= 0.5
    assert np.mean(said == (b.toxic == 1)) > 0.96
    assert np.mean(said[(b.toxic == 0).to_numpy()]) < 0.03  # clean documents stay


def test_toxicity_model_equals_a_plain_one(spark, make_docs):
    """Counts, ratios and the regression by loops over sets of n-grams."""
    rng = random.Random(5)
    rows, y = [], []
    for i in range(180):
        y.append(i % 3 == 0)
        rows.append((i, " ".join(rng.choice(["mild", "warm", "soft", "calm", "cold"] + ["vile"] * 8 * y[-1]) for _ in range(6))))
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(y)], "doc_id long, toxic int")
    model = X.fit_on(make_docs(rows), labels, l2=0.5, steps=3000)
    grams = []
    for _, t in rows:
        words = {f" {w} " for w in t.split()}
        grams.append({w[j : j + n] for w in words for n in X.ORDERS for j in range(len(w) - n + 1)})
    every = sorted(set().union(*grams))
    bucket = {g: _bucket(g) for g in every}
    assert len(set(bucket.values())) == len(every)
    ratio, kept = {}, []
    for g in every:
        df = [sum(g in x for x, t in zip(grams, y) if t == k) for k in (False, True)]
        ratio[g] = math.log((df[1] + 1) / 62) - math.log((df[0] + 1) / 122)
        if abs(ratio[g]) > 4 * math.sqrt(1 / (df[1] + 1) + 1 / (df[0] + 1)):
            kept.append(g)
    assert kept and set(np.flatnonzero(model.weights)) == {bucket[g] for g in kept}
    x = np.array([[ratio[g] * (g in s) for g in kept] for s in grams])
    w = np.array([model.weights[bucket[g]] / ratio[g] for g in kept])
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))  # all labels are used: the prior moves nothing
    assert np.allclose(X.scores([t for _, t in rows], model), p, atol=1e-4)
    assert np.abs(x.T @ (p - np.array(y)) / 180 + 0.5 * w / 180).max() < 1e-3 and abs(np.mean(p - np.array(y))) < 1e-3


def _bucket(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * int(X._MULTIPLIER) + ord(c)) % 2**64
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * m % 2**64
    return (h ^ (h >> 33)) >> (64 - X.BITS)


def test_no_toxic_ngram_beyond_noise(spark, make_docs):
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    model = X.fit_on(make_docs([(0, "one"), (1, "two")]), labels)
    assert not model.weights.any() and X.score(make_docs([(2, "two")]), model).first()["toxic"] is False


def test_documents_of_one_id_count_with_the_least_text(spark, make_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    rows, _ = labelled.sample(make_docs([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, "d")]), labels, "toxic", 9)
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 0), (2, "c", 1)]


def test_first_tree_splits_where_all_gains_are_compared(halves):
    """The root and its leaves against every cut of every statistic."""
    a, _ = halves
    x, y = Q.statistics(a.text.tolist()[:400]), a.quality.to_numpy()[:400].astype(float)
    model = Q.fit(x, y, trees=1, depth=1, bins=16, rate=1.0)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (0, None, None)
    for j in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower")):
            left = x[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) < 2:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-9:
                best = (gain, j, cut)
    assert (model.feature[0, 0], model.threshold[0, 0]) == (best[1], np.float32(best[2]))
    left = x[:, best[1]] <= np.float32(best[2])
    assert model.leaf[0] == pytest.approx([-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_quality_on_held_out_labels(halves):
    a, b = halves
    model = Q.fit(Q.statistics(a.text.tolist()), a.quality.to_numpy())
    said = Q.scores(b.text.tolist(), model) >= 0.5
    assert np.mean(said == (b.quality == 1)) > 0.95


def test_vectorised_traversal_equals_a_walk(halves):
    a, b = halves
    model = Q.fit(Q.statistics(a.text.tolist()), a.quality.to_numpy(), trees=7, depth=3)
    x = Q.statistics(b.text.tolist())
    got = model.margin(x)
    for i in range(20):
        total = model.start
        for t in range(7):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if x[i, model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.leaf[t, node - 7]
        assert abs(total - got[i]) < 1e-9


def test_statistics_by_hand():
    s = dict(zip(Q.STATISTICS, Q.statistics(["One two. One two.\nOne two. One two."])[0]))
    assert s["log_words"] == pytest.approx(np.log1p(8)) and s["repeated_lines"] == 0.5 and s["ended_lines"] == 1.0
    assert s["distinct_words"] == 0.25 and s["upper"] == pytest.approx(4 / 35)


@pytest.mark.parametrize("module,column", [(X, "toxic"), (Q, "keep")])
def test_awkward_rows(spark, awkward, make_docs, module, column):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (7, 5, 5)], "doc_id long, quality int, toxic int")
    model = module.fit_on(awkward, labels)
    rows = module.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.reject(awkward, model).columns == awkward.columns
    assert module.score(make_docs([]), model).count() == 0 and module.reject(make_docs([]), model).count() == 0
    if module is X:
        assert not any(r["toxic"] for r in rows if r["doc_id"] in (1, 2, 3, 7))


@pytest.mark.parametrize("module", [X, Q])
def test_without_labels_nothing_is_rejected(spark, awkward, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.fit_on(awkward, none) is None
    assert module.reject(awkward, None).count() == awkward.count()


def test_sample_is_bounded_and_ignores_contradictions(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0)], "doc_id long, toxic int")
    rows, totals = labelled.sample(docs, labels, "toxic", 5)
    texts, y = zip(*((r["__text"], r["__y"]) for r in rows.collect()))
    assert len(texts) == 10 and sum(y) == 5 and totals == {0: 20, 1: 19} and "text 3" not in texts


def test_url_model_on_held_out_hosts():
    """Split by host: no host of the test half is in the other."""
    rows = U.labelled_urls()
    fold = [zlib.crc32(U.parts(u)[0].encode()) % 4 for u, _ in rows]
    said, truth = [], []
    for k in range(4):
        model = U.fit([r for r, f in zip(rows, fold) if f != k])
        held = [r for r, f in zip(rows, fold) if f == k]
        said += (U.scores([u for u, _ in held], model) >= 0.5).tolist()
        truth += [y == 1 for _, y in held]
    said, truth = np.array(said), np.array(truth)
    assert np.mean(said == truth) > 0.9 and np.mean(said[~truth]) < 0.02 and np.mean(said[truth]) > 0.75


def test_url_model_on_well_known_hosts_that_the_table_lacks():
    ordinary = ["github.com", "stackoverflow.com", "www.linkedin.com", "www.bestbuy.com", "pharmacy.ufl.edu", "www.essex.ac.uk"]
    betting = ["bet365.com", "www.draftkings.com"]
    known = {U.parts(u)[0] for u, _ in U.labelled_urls()}
    assert not known & {*ordinary, *betting}
    model = U.fit(U.labelled_urls())
    blocked = lambda hosts: (U.scores([f"https://{h}/" for h in hosts], model) >= 0.5).tolist()
    assert not any(blocked(ordinary)) and all(blocked(betting))
    assert (U.scores(["http://user@cheap-meds24.net:80/buy?x=1", "https://maths.org/lectures/3"], model) >= 0.5).tolist() == [True, False]


def plain_url_features(url):
    """Feature numbers by loops over the n-grams."""
    out = set()
    host, path = U.parts(url)
    for half, text in enumerate((f"^{host}$" if host else "", f"{path}$" if path else "")):
        for n in U.ORDERS:
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * int(U._MULTIPLIER) + ord(c)) % 2**64
                h = (h + n) % 2**64
                for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                    h = (h ^ (h >> 33)) * m % 2**64
                out.add((half << (U.BITS - 1)) | ((h ^ (h >> 33)) >> (65 - U.BITS)))
    return out


def test_url_features_and_scores_equal_plain_ones(spark, sf):
    model = U.fit(U.labelled_urls())
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + ["", None, "a", "http://ab", "https://x.org/é/…", "https://a.org/aaaaaaa"]
    row, col = U.features(urls)
    got = U.scores(urls, model)
    by = {}
    for i, c in zip(row.tolist(), col.tolist()):
        by.setdefault(i, set()).add(c)
    for i, url in enumerate(urls):
        want = plain_url_features(url)
        assert by.get(i, set()) == want
        total = sum(model.weights[c] for c in want) / math.sqrt(max(len(want), 1)) + model.intercept
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_url_fit_is_the_minimum_of_its_loss():
    """On a small table the weights' gradient vanishes before the prior moves the intercept."""
    rows = [("https://good-books.org/read", 0), ("https://casino-win.com/slots", 1), ("https://garden.net/", 0), ("https://poker-slots.biz/win", 1)]
    model = U.fit(rows, prior=0.5, l2=0.05, steps=4000)
    y = np.array([r[1] for r in rows], float)
    row, col = U.features([u for u, _ in rows])
    x = np.zeros((4, 1 << U.BITS))
    x[row, col] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    p = 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))
    assert np.abs(x.T @ (p - y) / 4 + 0.05 * model.weights / 4).max() < 1e-3


def test_url_parts():
    assert U.parts("HTTPS://Me:pw@Www.A.org:443/P/q.html?x#y") == ("www.a.org", "/p/q.html")
    assert U.parts(None) == U.parts("") == ("", "") and U.parts("a.b/c") == ("a.b", "/c")


def test_url_awkward_rows(spark, sf):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "https://a.org/", "x"), (3, "https://a.org/" + "b" * 50_000, "x"), (3, "https://a.org/", "x")], "page_id long, url string, score string")
    rows = U.score(pages, U.fit(U.labelled_urls())).collect()
    assert len(rows) == 5 and not any(r["blocked"] for r in rows if r["page_id"] in (1, 2, None))
    assert U.score(pages.limit(0), U.fit(U.labelled_urls())).count() == 0 and U.fit([("a", 1)]) is None


def test_queries_cover_their_tables(spark, sf):
    for name, table in (("op4_toxicity", "documents"), ("op8_quality_classifier", "documents"), ("op9_url_filter", "pages")):
        assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
