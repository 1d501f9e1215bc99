"""URL filter: logistic regression on hashed character n-grams of host and path.

N-grams of 3 to 5 characters of the host and of the path are hashed into
separate halves of one feature table; a feature counts once a URL.  The model is
fitted on a small labelled table of URLs, by default ``labelled_urls.tsv``, which
lists known sites of both kinds; hosts that aren't in it are judged by the parts
of their names.

Defined results: scores are rounded to nine places.  The scheme, user part, port, query and fragment are not read;
case doesn't matter.  A null or empty URL has only the intercept's score, capped
below one half, and is never blocked.  With labels of one class nothing is
blocked and every score is 0.  Each input row gives one output row; a null
``page_id`` stays null.  Only the two columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernel

BITS = 16
ORDERS = (3, 4, 5)
PRIOR = 0.2
PLACES = 9
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)(?::\d*)?([^?#]*)", re.I | re.S)


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (URL, 1 for blocked)."""
    lines = (Path(__file__).parent / "labelled_urls.tsv").read_text("utf-8").splitlines()[1:]
    return [(url, int(blocked)) for url, blocked in (line.split("\t") for line in lines)]


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) in lower case."""
    m = _URL.match((url or "").strip().lower())
    return m.group(1), m.group(2)


def features(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs."""
    split = [parts(u) for u in urls]
    found = []
    for half, texts in enumerate(([f"^{h}$" if h else "" for h, _ in split], [f"{p}$" if p else "" for _, p in split])):
        t = kernel.Texts(texts)
        doc = t.doc_of().astype(np.int64)
        codes = t.codes.astype(np.uint64)
        h = codes
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * _MULTIPLIER + codes[n - 1 :]
            if n in ORDERS:
                whole = (doc[: len(h)] == doc[n - 1 :]) & (codes[n - 1 :] != 0)
                bucket = (kernel.mix(h[whole] + np.uint64(n)) >> np.uint64(65 - BITS)).astype(np.int64)
                found.append((doc[: len(h)][whole] << BITS) | (half << (BITS - 1)) | bucket)
    key = np.unique(np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def fit(rows: list[tuple[str, int]], prior: float = PRIOR, l2: float = 0.0005, steps: int = 500) -> Model | None:
    """Logistic regression; the intercept then moves from the table's share of
    blocked URLs to ``prior``, the share that is expected in use."""
    y = np.array([r[1] for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    row, col = features([r[0] for r in rows])
    norm = 1 / np.sqrt(np.bincount(row, minlength=len(y)))
    x = norm[row]
    w, b = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], minlength=len(y)) + b, -40, 40)))
        g = np.bincount(col, x * (p - y)[row], minlength=len(w)) / len(y) + l2 * w / len(y)
        gb = float(np.mean(p - y))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - i / (steps + 1))
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.99**i)) + 1e-8)
    b += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return Model(w, min(b, -1e-3))


def scores(urls: list, model: Model | None) -> np.ndarray:
    if model is None or not urls:
        return np.zeros(len(urls))
    row, col = features(urls)
    norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(urls)), 1))
    total = np.bincount(row, model.weights[col] * norm[row], minlength=len(urls)) + model.intercept
    return np.round(1 / (1 + np.exp(-np.clip(total, -40, 40))), PLACES)


def score(pages: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(page_id, score, blocked) for every row."""

    def fn(part, urls):
        p = scores(urls, model)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold)], names=["page_id", "score", "blocked"])

    return pages.selectExpr("cast(page_id as long) page_id", "url").mapInArrow(kernel.per_slice(fn, "url"), "page_id long, score double, blocked boolean")


def oracle_sql(model: Model | None = None) -> str:
    """Features and scores of ``pages`` in DuckDB's SQL, with the fitted weights."""
    model = model or fit(labelled_urls())
    weights = ",".join(f"({i},{float(model.weights[i])!r})" for i in np.flatnonzero(model.weights))
    wide = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    url = r"'(?s)^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)(?::\d*)?([^?#]*)'"
    low = r"regexp_replace(lower(coalesce(url, '')), '^\s+|\s+$', '', 'g')"
    steps, last = [], "g1"
    for i in range(2, max(ORDERS) + 1):
        steps.append(f"g{i} AS (SELECT owner, half, g, n, CASE WHEN n >= {i} THEN {wide(f'h::UHUGEINT * {int(_MULTIPLIER)}::UHUGEINT + unicode(g[{i}])::UHUGEINT')} ELSE h END AS h FROM {last})")
        last = f"g{i}"
    steps.append(f"m0 AS (SELECT owner, half, {wide('h::UHUGEINT + n::UHUGEINT')} AS h FROM {last})")
    for i, m in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
        steps.append(f"m{i + 1} AS (SELECT owner, half, {wide(f'xor(h, h >> 33)::UHUGEINT * {m}::UHUGEINT')} AS h FROM m{i})")
    chain = ",\n".join(steps)
    return f"""
WITH w(feature, weight) AS (VALUES {weights}),
d AS MATERIALIZED (SELECT row_number() OVER () AS owner, page_id::BIGINT AS page_id, regexp_extract({low}, {url}, 1) AS host, regexp_extract({low}, {url}, 2) AS path FROM pages),
texts AS (SELECT owner, 0 AS half, '^' || host || '$' AS t FROM d WHERE host <> '' UNION ALL SELECT owner, 1, path || '$' FROM d WHERE path <> ''),
cut AS (SELECT owner, half, n, substr(t, i, n) AS g FROM (SELECT owner, half, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT *, unnest({list(ORDERS)}) AS n FROM texts) WHERE length(t) >= n)),
g1 AS (SELECT owner, half, g, n, unicode(g[1])::UBIGINT AS h FROM (SELECT DISTINCT owner, half, g, n FROM cut)),
{chain},
features AS (SELECT DISTINCT owner, half * {1 << (BITS - 1)} + (xor(h, h >> 33) >> {65 - BITS})::BIGINT AS feature FROM m2),
total AS (SELECT owner, coalesce(sum(weight), 0) / sqrt(count(*)) AS s FROM features LEFT JOIN w USING (feature) GROUP BY owner),
scored AS (SELECT page_id, round(1 / (1 + exp(-greatest(-40, least(40, coalesce(s, 0) + {float(model.intercept)!r})))), {PLACES}) AS score FROM d LEFT JOIN total USING (owner))
SELECT page_id, score, score >= 0.5 AS blocked FROM scored"""
