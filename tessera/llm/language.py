"""Language identification by rank-order n-gram profiles.

A text's profile lists its ``length`` most frequent n-grams (1 to 5 characters
of lower-case words with a blank at either end), most frequent first.  Its
distance to a language is the sum over those n-grams of how far out of place
each is in the language's profile, ``length`` for one that is not there.  The
nearest language wins.

Language profiles are made from the ``lang`` column of at most ``most`` ids a
language, those with the least MD5; all documents with such an id count.

N-grams are 34-bit hashes.  Defined results: equally frequent n-grams rank by hash.  Equally near
languages rank by name.  A null, empty or letterless text has a null language and
distance, and so has every text when no labelled text is there.  A null or empty
``lang`` labels nothing.  Each input row gives one output row; a null ``doc_id``
stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import kernel

ORDERS = (1, 2, 3, 4, 5)
LENGTH = 300
MOST_LABELLED = 300
_HASH_BITS, _COUNT_BITS = 34, 20
_MOST_TEXTS = 1 << (64 - _HASH_BITS - _COUNT_BITS)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def counts(texts: list, orders=ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), sorted by text and n-gram; n-grams are hashes."""
    t = kernel.Texts(texts, lower=True)
    letter = (t.cls == kernel.LOWER) | (t.cls == kernel.UPPER)
    codes = np.concatenate(([np.uint64(32)], np.where(letter, t.codes, 32).astype(np.uint64)))
    doc = np.concatenate(([0], t.doc_of())).astype(np.int64)
    gaps = np.concatenate(([0], np.cumsum(codes == 32, dtype=np.int32)))
    h, found = codes + np.uint64(1), []
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * _MULTIPLIER + codes[n - 1 :]
        if n in orders:
            m = len(h)
            # no blank within, and not a blank alone
            inside = codes[:m] != 32 if n == 1 else gaps[n - 1 : n - 1 + m] == gaps[1 : 1 + m]
            if n == 2:
                inside &= (codes[:m] != 32) | (codes[1 : 1 + m] != 32)
            at = np.flatnonzero(inside)
            gram = (kernel.mix(h[at] + np.uint64(n)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)
            found.append((doc[at + (n > 1)] << _HASH_BITS) | gram)
    key = np.concatenate(found)
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((new, [len(key)])))
    return key[new] >> _HASH_BITS, key[new] & ((1 << _HASH_BITS) - 1), count


def profiles(texts: list, length: int = LENGTH, orders=ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank from 0, n-gram) of each text's most frequent n-grams."""
    doc, gram, count = counts(texts, orders)
    top = (1 << _COUNT_BITS) - 1
    if len(count) and count.max() > top:  # texts of millions of characters
        order = np.lexsort((gram, -count, doc))
        doc, gram = doc[order], gram[order]
    else:
        key = (doc.astype(np.uint64) << np.uint64(64 - 10)) | ((top - count).astype(np.uint64) << np.uint64(_HASH_BITS)) | gram.astype(np.uint64)
        key.sort()
        doc, gram = (key >> np.uint64(54)).astype(np.int64), (key & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)
    base = kernel.offsets(doc, len(texts))
    rank = np.arange(len(doc)) - base[doc]
    keep = rank < length
    return doc[keep], rank[keep], gram[keep]


@dataclass
class Profiles:
    names: list[str]
    grams: np.ndarray  # sorted n-grams of all profiles
    ranks: np.ndarray  # language x gram; ``length`` where absent
    length: int


def assemble(by_language: dict[str, list[int]], length: int = LENGTH) -> Profiles:
    """Profiles from each language's n-grams in rank order."""
    names = sorted(by_language)
    grams = np.unique(np.concatenate([np.asarray(by_language[n], np.int64) for n in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(grams) + 1), length, np.int64)  # the last column: absent
    for i, n in enumerate(names):
        own = np.asarray(by_language[n], np.int64)
        ranks[i, np.searchsorted(grams, own)] = np.arange(len(own))
    return Profiles(names, grams, ranks, length)


def fit_on(docs: DataFrame, most: int = MOST_LABELLED, length: int = LENGTH) -> Profiles:
    ids = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("lang").alias("__lang")).where("__id is not null and __lang is not null and __lang <> ''")
    order = Window.partitionBy("__lang").orderBy(F.md5(F.col("__id").cast("string")), F.col("__id"))
    # bounded by languages * most rows, whatever the input
    chosen = ids.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).select("__id", "__lang").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).where("__text is not null").join(F.broadcast(chosen), "__id")

    def fn(part, texts):
        names = part.column(2).to_pylist()
        kinds = sorted(set(names))
        doc, gram, count = counts(texts)
        which = np.array([kinds.index(x) for x in names])[doc]
        key, inverse = np.unique((which << _HASH_BITS) | gram, return_inverse=True)
        total = np.bincount(inverse, count).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in key >> _HASH_BITS], pa.string()), pa.array(key & ((1 << _HASH_BITS) - 1)), pa.array(total)], names=["lang", "gram", "n"])

    parts = rows.select("__id", "__text", "__lang").mapInArrow(_per_slice(fn, "__text"), "lang string, gram long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= length)
    by: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        by.setdefault(r["lang"], []).append(r["gram"])
    return assemble(by, length)


def _per_slice(fn, column: str = "text"):
    """As kernel.per_slice, with no more texts at once than a key can number."""
    whole = kernel.per_slice(lambda part, texts: part, column)

    def run(batches):
        for part in whole(batches):
            for at in range(0, part.num_rows, _MOST_TEXTS):
                piece = part.slice(at, _MOST_TEXTS)
                yield fn(piece, piece.column(piece.schema.get_field_index(column)).to_pylist())

    return run


def distances(texts: list, known: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(distance[text, language], whether the text has any n-gram)."""
    doc, rank, gram = profiles(texts, known.length)
    at = np.searchsorted(known.grams, gram)
    at = np.where((at < len(known.grams)) & (known.grams[np.minimum(at, len(known.grams) - 1)] == gram), at, len(known.grams))
    out = np.zeros((len(texts), len(known.names)), np.int64)
    for i in range(len(known.names)):
        there = known.ranks[i][at]
        out[:, i] = np.bincount(doc, np.where(there < known.length, np.abs(there - rank), known.length), minlength=len(texts))
    return out, np.bincount(doc, minlength=len(texts)) > 0


def identify(docs: DataFrame, known: Profiles) -> DataFrame:
    """(doc_id, language, distance, margin) for every row.

    ``margin`` is by how much the second language is farther; null with one.
    """

    def fn(part, texts):
        n = len(texts)
        if known.names:
            d, some = distances(texts, known)
            order = np.argsort(d, axis=1, kind="stable")
            first = d[np.arange(n), order[:, 0]]
            name = [known.names[i] if s else None for i, s in zip(order[:, 0].tolist(), some.tolist())]
            margin = pa.array(d[np.arange(n), order[:, 1]] - first, mask=~some) if len(known.names) > 1 else pa.nulls(n, pa.int64())
            distance = pa.array(first, mask=~some)
        else:
            name, distance, margin = [None] * n, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), distance, margin], names=["doc_id", "language", "distance", "margin"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_per_slice(fn), "doc_id long, language string, distance long, margin long")


_GRAMS = """
padded AS (SELECT owner, ' ' || word || ' ' AS w, count(*) AS c FROM (SELECT owner, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM TEXTS) GROUP BY ALL),
cut AS (SELECT owner, substr(w, i, n) AS g, c FROM (SELECT owner, w, c, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS n FROM padded) WHERE length(w) >= n)),
counted AS MATERIALIZED (SELECT owner, g, sum(c) AS c FROM cut WHERE g <> ' ' GROUP BY ALL)"""


def _hashes(grams: str) -> str:
    """CTEs that hash the n-grams g of a relation, as ``counts`` does: hashed(g, gram)."""
    wide = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    steps, last = [f"h1 AS (SELECT g, length(g) AS n, {wide('unicode(g[1])::UHUGEINT + 1')} AS h FROM (SELECT DISTINCT g FROM {grams}))"], "h1"
    for i in range(2, max(ORDERS) + 1):
        steps.append(f"h{i} AS (SELECT g, n, CASE WHEN n >= {i} THEN {wide(f'h::UHUGEINT * {int(_MULTIPLIER)}::UHUGEINT + unicode(g[{i}])::UHUGEINT')} ELSE h END AS h FROM {last})")
        last = f"h{i}"
    steps.append(f"m0 AS (SELECT g, {wide('h::UHUGEINT + n::UHUGEINT')} AS h FROM {last})")
    for i, m in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
        steps.append(f"m{i + 1} AS (SELECT g, {wide(f'xor(h, h >> 33)::UHUGEINT * {m}::UHUGEINT')} AS h FROM m{i})")
    steps.append(f"hashed AS MATERIALIZED (SELECT g, (xor(h, h >> 33) >> {64 - _HASH_BITS})::BIGINT AS gram FROM m2)")
    return ",\n".join(steps)


def oracle_sql() -> str:
    """The query on ``documents`` in DuckDB's SQL."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS owner, doc_id::BIGINT AS doc_id, text, lang FROM documents),
{_GRAMS.replace("TEXTS", "d")},
{_hashes("counted")},
own AS MATERIALIZED (SELECT owner, gram, sum(c) AS c FROM counted JOIN hashed USING (g) GROUP BY ALL),
ranked AS (SELECT owner, gram, row_number() OVER (PARTITION BY owner ORDER BY c DESC, gram) - 1 AS place FROM own QUALIFY place < {LENGTH}),
ids AS (SELECT DISTINCT doc_id, lang FROM (SELECT doc_id, lang FROM d WHERE doc_id IS NOT NULL AND lang <> '' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= {MOST_LABELLED})),
known AS MATERIALIZED (SELECT ids.lang, gram, row_number() OVER (PARTITION BY ids.lang ORDER BY sum(c) DESC, gram) - 1 AS home
  FROM d JOIN ids USING (doc_id) JOIN own USING (owner) GROUP BY ids.lang, gram QUALIFY home < {LENGTH}),
far AS (SELECT owner, l.lang, sum(CASE WHEN home IS NULL THEN {LENGTH} ELSE abs(home - place) END) AS distance
  FROM ranked CROSS JOIN (SELECT DISTINCT lang FROM known) l LEFT JOIN known k ON k.lang = l.lang AND k.gram = ranked.gram GROUP BY ALL),
placed AS (SELECT owner, lang, distance, lead(distance) OVER (PARTITION BY owner ORDER BY distance, lang) - distance AS margin, row_number() OVER (PARTITION BY owner ORDER BY distance, lang) AS n FROM far)
SELECT doc_id, placed.lang AS language, distance::BIGINT AS distance, margin::BIGINT AS margin FROM d LEFT JOIN placed ON d.owner = placed.owner AND n = 1"""
