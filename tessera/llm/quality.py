"""Quality by histogram gradient-boosted trees over document statistics.

Each document becomes a row of statistics (class shares of its characters, word
and line figures, repetition).  Trees are grown on histograms of binned
statistics from a bounded labelled sample and flattened into arrays of split
features, thresholds and leaves; scoring walks all trees for a slice of
documents at once with numpy, one step a level.

Defined results: a null text counts as an empty one.  An empty or wordless text
has all statistics 0 and is scored like any other.  With no usable labels of
one class every document is kept with score 1.  Each input row gives one output
row; a null ``doc_id`` stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernel, labelled

MOST_LABELLED = 10_000
DEPTH = 4
TREES = 80
BINS = 64

_KINDS = 16
_SYMBOLS = {"|": 6, "!": 7, "*": 8, "#": 8, "$": 8, "%": 8, "&": 8, ".": 9, ",": 10, "?": 11, ";": 12, ":": 12, '"': 13, "'": 13, "«": 13, "»": 13, "-": 14, "_": 14, "/": 14, "<": 15, ">": 15, "{": 15, "}": 15, "=": 15, "\\": 15}
_SYMBOL_TABLE = np.zeros(256, np.uint8)
for _c, _k in _SYMBOLS.items():
    _SYMBOL_TABLE[ord(_c)] = _k

STATISTICS = (
    ["log_chars", "log_words", "mean_word", "upper", "lower", "digit", "space", "newline", "bar", "exclaim", "symbol", "stop", "comma", "question", "colon", "quote", "dash", "markup", "other"]
    + ["distinct_words", "top_word", "distinct_pairs", "long_words", "capital_words", "symbol_words", "repeated_lines", "repeated_line_chars", "log_lines", "mean_line", "short_lines", "ended_lines"]
)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of its most frequent."""
    key = np.sort((h >> np.uint64(20)) | (doc.astype(np.uint64) << np.uint64(44)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    runs = np.diff(np.concatenate((new, [len(key)])))
    owner = (key[new] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(texts: list) -> np.ndarray:
    """One row of STATISTICS for each text."""
    t = kernel.Texts(texts)
    n = t.n
    doc_of = t.doc_of()
    kind = t.cls.astype(np.int32)
    plain = (kind == kernel.OTHER) & (t.codes < 256)
    kind[plain] = _SYMBOL_TABLE[t.codes[plain]]
    counts = np.bincount(doc_of * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    counts[:, 0] -= 1  # the separator
    chars = np.maximum(t.lens, 1)[:, None]
    share = counts / chars
    doc, s, e = kernel.words(t)
    n_words = np.bincount(doc, minlength=n).astype(float)
    per = np.maximum(n_words, 1)
    size = e - s
    h = kernel.span_hashes(t.codes, s, e)
    kinds, top = _distinct(doc, h, n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = _distinct(doc[pair], kernel.mix(h[pair] * np.uint64(31) + h[pair + 1]), n)
    upper = t.cls == kernel.UPPER
    capital = upper[s] & upper[e - 1] & (size > 1)
    after = t.codes[e]  # at the least the separator
    marked = np.isin(after, [33, 35, 36, 37, 38, 42, 124]) if len(after) else np.zeros(0, bool)
    # lines: runs between line ends and document ends
    ends = (t.cls == kernel.NEWLINE) | (t.codes == 0)
    ls, le = kernel.spans(~ends)
    line_doc = np.searchsorted(t.starts, ls, side="right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    per_line = np.maximum(lines, 1)
    line_hash = kernel.span_hashes(t.codes, ls, le)
    distinct_lines, _ = _distinct(line_doc, line_hash, n)
    key = kernel.mix(line_hash ^ kernel.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    length = le - ls
    ended = np.isin(t.codes[le - 1], [33, 46, 63, 0x2026]) if len(le) else np.zeros(0, bool)
    by = lambda owner, value: np.bincount(owner, value, minlength=n)
    columns = [
        np.log1p(t.lens), np.log1p(n_words), by(doc, size) / per,
        share[:, kernel.UPPER], share[:, kernel.LOWER], share[:, kernel.DIGIT], share[:, kernel.SPACE], share[:, kernel.NEWLINE],
        *(share[:, k] for k in range(6, 16)), share[:, 0],
        kinds / per, top / per, pairs / np.maximum(n_words - 1, 1), by(doc, size > 12) / per, by(doc, capital) / per, by(doc, marked) / per,
        (lines - distinct_lines) / per_line, by(line_doc, length * again) / chars[:, 0], np.log1p(lines), by(line_doc, length) / per_line, by(line_doc, length < 20) / per_line, by(line_doc, ended) / per_line,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Perfect binary trees of one depth; node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # int, trees x inner nodes
    threshold: np.ndarray  # float32; a row goes right where its value is above
    leaf: np.ndarray  # float, trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        tree = np.arange(trees)
        row = np.arange(len(x))[:, None]
        while inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            inner >>= 1
        return self.start + self.leaf[tree, node - self.feature.shape[1]].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees | None:
    """Boosting for logistic loss; None unless both classes are there."""
    if len(y) == 0 or y.min() == y.max():
        return None
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, start)
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            local = node - first
            best, split = np.full(many, 1e-6), np.full((many, 2), -1)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                key = local * bins + binned[:, j]
                hg = np.bincount(key, g, minlength=many * bins).reshape(many, bins)
                hh = np.bincount(key, h, minlength=many * bins).reshape(many, bins)
                gl, hl = hg.cumsum(1), hh.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, : len(cuts[j])]
                at = gain.argmax(1)
                value = gain[np.arange(many), at]
                better = value > best
                best[better] = value[better]
                split[better] = np.stack([np.full(many, j), at], axis=1)[better]
            for i in range(many):
                if split[i, 0] >= 0:
                    feature[k, first + i], threshold[k, first + i] = split[i, 0], cuts[split[i, 0]][split[i, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        node -= inner
        hg, hh = np.bincount(node, g, minlength=inner + 1), np.bincount(node, h, minlength=inner + 1)
        leaf[k] = -rate * hg / (hh + l2)
        margin += leaf[k, node]
    return Trees(feature, threshold, leaf, start)


def prior(totals: dict[int, int], most: int) -> float:
    """Log-odds of all labels less those of at most ``most`` of each class."""
    bad, good = totals[0], totals[1]
    return float(np.log(good / bad) - np.log(min(good, most) / min(bad, most)))


def fit_on(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees | None:
    """Trees from a labelled sample of at most ``most`` documents of each class, of
    which only the statistics come to the driver.  The start log-odds get back the
    class ratio that the bound takes away."""
    rows, totals = labelled.sample(docs, labels, "quality", most)

    def fn(part, texts):
        x = statistics(texts)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "y", "x"])

    got = rows.mapInArrow(kernel.per_slice(fn, "__text"), "id long, y int, x array<float>").toPandas().sort_values("id")
    if not len(got):
        return None
    model = fit(np.stack(got["x"].to_list()).astype(np.float32), got["y"].to_numpy())
    if model is not None:
        model.start += prior(totals, most)
    return model


def scores(texts: list, model: Trees | None) -> np.ndarray:
    """Probability that each text is of good quality."""
    if model is None:
        return np.ones(len(texts))
    return 1 / (1 + np.exp(-model.margin(statistics(texts))))


def score(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for every row."""

    def fn(part, texts):
        p = scores(texts, model)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "score", "keep"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(kernel.per_slice(fn), "doc_id long, score double, keep boolean")


def reject(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The rows of good quality, with the columns they had."""

    def fn(part, texts):
        return part.filter(pa.array(scores(texts, model) >= threshold))

    return docs.mapInArrow(kernel.per_slice(fn), docs.schema)
