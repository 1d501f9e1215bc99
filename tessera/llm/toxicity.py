"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

A document is the set of its hashed character n-grams within words (a word's
edges count as a character).  Each is scaled by its naive Bayes log-count ratio
between toxic and clean labelled documents, and logistic regression is fitted
on the scaled features.  N-grams whose ratio is within noise, four standard errors,
are left out at every size of the sample, so the model is a table of 2**BITS
weights, few of which are not zero; where none is beyond noise nothing is toxic.

Fitting uses at most ``most`` labelled documents of each class; scoring reads
whole texts in one Arrow pass without a shuffle.

Defined results: a null, empty or wordless text has no features and so the
score of the intercept alone, capped below one half: it is never toxic.  With no
usable labels of one class nothing is toxic and every score is 0.  Each input
row gives one output row; repeated rows give repeated results, and a null
``doc_id`` stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, labelled, scratch

BITS = 18
ORDERS = (3, 4, 5, 6)
MOST_LABELLED = 4000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**BITS
    intercept: float


def ngrams(texts: list, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order; only wanted buckets if given."""
    t = kernel.Texts(texts, lower=True)
    letter = (t.cls >= kernel.DIGIT) & (t.cls <= kernel.UPPER)
    codes = np.concatenate(([np.uint64(32)], np.where(letter, t.codes, 32).astype(np.uint64)))
    doc = np.concatenate(([np.int32(0)], t.doc_of()))
    gaps = np.concatenate(([0], np.cumsum(codes == 32, dtype=np.int32)))
    h, found = codes, []
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * _MULTIPLIER + codes[n - 1 :]
        if n in ORDERS:
            m = len(h)
            inside = gaps[n - 1 : n - 1 + m] == gaps[1 : 1 + m]
            bucket = (kernel.mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64)
            owner = doc[1:][np.flatnonzero(inside)] if m < len(doc) else doc[inside]
            if wanted is not None:
                keep = wanted[bucket]
                bucket, owner = bucket[keep], owner[keep]
            found.append((owner.astype(np.int64) << BITS) | bucket)
    key = np.concatenate(found)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key >> BITS, key & ((1 << BITS) - 1)


def ratios(df: np.ndarray, n: np.ndarray, alpha: float = 1.0, z: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(naive Bayes log-count ratio of each bucket, whether it is beyond noise).

    ``df`` holds the clean and the toxic documents with each bucket, ``n`` all
    clean and toxic ones.
    """
    ratio = np.log((df[1] + alpha) / (n[1] + 2 * alpha)) - np.log((df[0] + alpha) / (n[0] + 2 * alpha))
    return ratio, np.abs(ratio) > z * np.sqrt(1 / (df[1] + alpha) + 1 / (df[0] + alpha))


def regress(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, totals: dict[int, int], l2: float = 0.3, steps: int = 250) -> Model:
    """Logistic regression on the buckets, each scaled by its ratio; the intercept
    then gets back the class ratio of the whole label table."""
    kinds, col = np.unique(col, return_inverse=True)
    scale = ratio[kinds]
    x = scale[col]
    w, b = np.zeros(len(kinds)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], minlength=len(y)) + b, -40, 40)))
        g = np.bincount(col, x * (p - y)[row], minlength=len(w)) / len(y) + l2 * w / len(y)
        gb = float(np.mean(p - y))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - i / (steps + 1)))
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.99**i)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kinds] = scale * w
    n = np.bincount(y, minlength=2)
    prior = np.log(max(totals.get(1, 1), 1) / max(totals.get(0, 1), 1)) - np.log(n[1] / n[0])
    return Model(weights, min(b + prior, -1e-3))


def fit_on(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, l2: float = 0.3, steps: int = 250) -> Model | None:
    """Model from a labelled sample of at most ``most`` documents of each class.

    Only counts by bucket and, of each document, the buckets beyond noise come to
    the driver; texts don't.
    """
    rows, totals = labelled.sample(docs, labels, "toxic", most)

    def fn(part, texts):
        doc, bucket = ngrams(texts)
        ends = kernel.offsets(doc, len(texts)).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["id", "y", "buckets"])

    seen = scratch.table(rows.mapInArrow(kernel.per_slice(fn, "__text"), "id long, y int, buckets array<int>"))
    n = np.zeros(2)
    for r in seen.groupBy("y").count().collect():
        n[r["y"]] = r["count"]
    if not n.all():
        scratch.drop(seen)
        return None
    got = seen.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).toArrow()
    df, bucket = np.zeros((2, 1 << BITS)), got["bucket"].to_numpy()
    df[1, bucket] = got["toxic"].to_numpy()
    df[0, bucket] = got["n"].to_numpy() - df[1, bucket]
    ratio, wanted = ratios(df, n)

    def beyond(batches):
        for b in batches:
            of, flat = np.asarray(pa.compute.list_parent_indices(b.column(2))), np.asarray(b.column(2).flatten())
            keep = wanted[flat]
            ends = kernel.offsets(of[keep], b.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[keep]))], names=["id", "y", "buckets"])

    kept = seen.mapInArrow(beyond, "id long, y int, buckets array<int>").orderBy("id").toArrow().combine_chunks()
    scratch.drop(seen)
    lists = kept["buckets"].combine_chunks()
    row, col = np.asarray(pa.compute.list_parent_indices(lists)), np.asarray(lists.flatten())
    return regress(row, col, kept["y"].to_numpy(), ratio, totals, l2, steps)


def scores(texts: list, model: Model | None) -> np.ndarray:
    """Probability that each text is toxic."""
    if model is None:
        return np.zeros(len(texts))
    doc, bucket = ngrams(texts, model.weights != 0)
    total = np.bincount(doc, model.weights[bucket], minlength=len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, toxic) for every row."""

    def fn(part, texts):
        p = scores(texts, model)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "score", "toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(kernel.per_slice(fn), "doc_id long, score double, toxic boolean")


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with the columns they had."""

    def fn(part, texts):
        return part.filter(pa.array(scores(texts, model) < threshold))

    return docs.mapInArrow(kernel.per_slice(fn), docs.schema)
