"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, names (capitalised words that do not
begin a sentence; neighbours count as one) and units after a number turn into
typed placeholders, other words into themselves in lower case.  Windows of
``window`` tokens are hashed and joined with those of the benchmark.  Matches of
one document and item that lie at the same offset are checked for their slots:
the placeholders' values must map one to one, as they do in a copy and in a
question that was only given other parameters; ``consistency`` of the pairs, or
all but one, have to.  Windows without placeholders count whatever the others'
values say.  A document is contaminated by
an item when the matches that pass cover at least ``coverage`` of its windows.

A window has at least half as many words as tokens.  An item without such a
window, as an arithmetic one, is compared by windows of up to ``rich`` tokens, the
whole item if it is that short, that have two words.

Windows of the plain tokens, in lower case and with numbers and names as they
are, are joined besides.  They need no literal minimum and no slots, so copies
are found however many placeholders they have and in whatever case.  A document
is contaminated by an item when the windows of either kind cover enough; the
figures are those of the template windows where these do.

The join is a hash join on 64-bit window hashes.  Where the benchmark has at
most ``most_sent`` windows (8 bytes each) their hashes are sent to the scan, which
then drops document windows that cannot join; a larger benchmark is joined by
shuffle.  The result is the same.

Defined results: null and empty texts have no windows.  Items of fewer than
``window`` tokens are one window of their own; below ``least`` tokens, or with
fewer than two words, they match as plain tokens only.  An item of a single token
matches nothing.  Rows with
a null id are never reported, and ``remove`` keeps such documents.  Rows that
share an id count as one document or item.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, scratch

WINDOW = 8
LEAST = 5
LEAST_PLAIN = 2
COVERAGE = 0.5
CONSISTENCY = 0.8
RICH = 16
MOST_SENT = 1_000_000
MOST_GONE = 128 << 20  # bytes

UNITS = """kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yard yards l ml liter liters litre litres
gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars usd euro euros eur cent cents pound pounds percent degree degrees celsius fahrenheit mph kmh w kw kwh v
meter meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres ton tons""".split()

_LOWER = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    _l = chr(_c).lower()
    if len(_l) == 1:
        _LOWER[_c] = ord(_l)
_NAME, _NUMBER, _UNIT = (np.uint64(x) for x in (0xA5A5A5A500000001, 0xA5A5A5A500000002, 0xA5A5A5A500000003))


def _word_hash(words: list[str]) -> np.ndarray:
    t = kernel.Texts(words)
    return kernel.span_hashes(t.codes, t.starts[:-1], t.starts[:-1] + t.lens)


_PLAIN, _RICH = np.uint64(0x5C5C5C5C00000004), np.uint64(0x5C5C5C5C00000005)
TEMPLATE, PLAINLY, RICHLY = 0, 1, 2  # kinds of windows
_UNIT_HASHES = np.sort(_word_hash(UNITS))


def _runs(texts: list) -> tuple:
    """(texts, lower code points, kinds, starts, ends) of words and numbers."""
    t = kernel.Texts(texts)
    low = np.where(t.codes < 0x3000, _LOWER[np.minimum(t.codes, 0x2FFF)], t.codes)
    kind = np.zeros(len(t.codes), np.int8)
    kind[t.cls == kernel.DIGIT] = 2
    dot = np.flatnonzero((t.codes == 46) | (t.codes == 44))
    dot = dot[(dot > 0) & (dot < len(kind) - 1)]
    kind[dot[(kind[dot - 1] == 2) & (kind[dot + 1] == 2)]] = 2
    kind[(t.cls == kernel.LOWER) | (t.cls == kernel.UPPER)] = 1
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.concatenate((edge[1:], [len(kind)]))
    real = kind[edge] > 0
    return t, low, kind, edge[real], end[real]


def plain_tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash in lower case) of every word and number."""
    t, low, _, s, e = _runs(texts)
    return np.searchsorted(t.starts, s, side="right") - 1, kernel.span_hashes(low, s, e)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, template code, slot value, is slot) of every template token."""
    t, low, kind, s, e = _runs(texts)
    doc = np.searchsorted(t.starts, s, side="right") - 1
    stops = ((t.codes == 46) | (t.codes == 33) | (t.codes == 63) | (t.codes == 58) | (t.codes == 59) | (t.codes == 124) | (t.cls == kernel.NEWLINE)) & (kind == 0)
    seen = np.cumsum(stops, dtype=np.int32)
    begins = np.ones(len(s), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (seen[s[1:]] != seen[e[:-1] - 1])
    number = kind[s] == 2
    name = ~number & (t.cls[s] == kernel.UPPER) & ~begins
    literal = kernel.span_hashes(low, s, e)
    unit = np.zeros(len(s), bool)
    unit[1:] = number[:-1] & (doc[1:] == doc[:-1]) & ~number[1:]
    unit[unit] = np.isin(literal[unit], _UNIT_HASHES)
    name &= ~unit
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, literal)))
    # neighbouring names are one
    lead = np.ones(len(s), bool)
    lead[1:] = ~(name[1:] & name[:-1] & (doc[1:] == doc[:-1]))
    group = np.flatnonzero(lead)
    last = np.concatenate((group[1:], [len(s)])) - 1 if len(group) else group
    value = kernel.span_hashes(low, s[group], e[last])
    return doc[group], code[group], value, (number | unit | name)[group]


def windows(doc: np.ndarray, code: np.ndarray, slot: np.ndarray, size: int, words: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of first token, hash) of each window with enough words, half of its
    tokens if no number is given."""
    many = len(code) - size + 1
    if many <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(many)
    literal = np.concatenate(([0], np.cumsum(~slot, dtype=np.int32)))
    fit = (doc[size - 1 :] == doc[:many]) & (literal[size:] - literal[:-size] >= (size / 2 if words is None else words))
    at = at[fit]
    return at, kernel.span_hashes(code, at, at + size) ^ np.uint64(size)


def plain_windows(doc: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of first token, hash) of each window of plain tokens."""
    at, h = windows(doc, code, np.zeros(len(code), bool), size)
    return at, h ^ _PLAIN


def rich_windows(doc: np.ndarray, code: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of first token, hash) of each window with two words."""
    at, h = windows(doc, code, slot, size, 2)
    return at, h ^ _RICH


def _rows(ids, doc, value, slot, at, h, size, base) -> pa.RecordBatch:
    """Windows as rows; slots hold the values of a window's placeholders."""
    inside = np.concatenate(([0], np.cumsum(slot)))
    values = value[slot].astype(np.int64)
    lo, hi = inside[at], inside[at + size]
    many = hi - lo
    ends = np.concatenate(([0], np.cumsum(many)))
    pick = np.repeat(lo - ends[:-1], many) + np.arange(ends[-1])
    slots = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[pick]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[at])), pa.array(h.astype(np.int64)), pa.array(at - base[doc[at]]), slots], names=["id", "hash", "place", "slots"])


_SCHEMA = "id long, hash long, place long, slots array<long>"


def _kind(rows: pa.RecordBatch, size: int, kind: int) -> pa.RecordBatch:
    rows = rows.append_column("size", pa.array(np.full(rows.num_rows, size, np.int32)))
    return rows.append_column("kind", pa.array(np.full(rows.num_rows, kind, np.int32)))


def benchmark_windows(benchmark: DataFrame, window: int, least: int, rich: int = RICH) -> DataFrame:
    """(id, hash, place, slots, size, kind) of the items' windows."""

    def fn(part, texts):
        doc, code, value, slot = tokens(texts)
        base = kernel.offsets(doc, len(texts))
        length = np.diff(base)
        out, some = [], np.zeros(len(texts), bool)
        for size in range(least, window + 1):
            at, h = windows(doc, code, slot, size)
            right = length[doc[at]] == size if size < window else length[doc[at]] >= size
            some[doc[at[right]]] = True
            if right.any():
                rows = _rows(part.column(0), doc, value, slot, at[right], h[right], size, base)
                out.append(_kind(rows, size, TEMPLATE))
        for size in range(least, rich + 1):
            at, h = rich_windows(doc, code, slot, size)
            right = ~some[doc[at]] & (length[doc[at]] == size if size < rich else length[doc[at]] >= size)
            if right.any():
                rows = _rows(part.column(0), doc, value, slot, at[right], h[right], size, base)
                out.append(_kind(rows, size, RICHLY))
        doc, code = plain_tokens(texts)
        base = kernel.offsets(doc, len(texts))
        length = np.diff(base)
        none = np.zeros(len(code), bool)
        for size in range(min(LEAST_PLAIN, window), window + 1):
            at, h = plain_windows(doc, code, size)
            right = length[doc[at]] == size if size < window else length[doc[at]] >= size
            if right.any():
                out.append(_kind(_rows(part.column(0), doc, code, none, at[right], h[right], size, base), size, PLAINLY))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    items = benchmark.selectExpr("cast(item_id as long) id", "text").where("id is not null and text is not null")
    return items.mapInArrow(kernel.per_slice(fn), _SCHEMA + ", size int, kind int")


def document_windows(docs: DataFrame, sizes: list[tuple[int, int]], wanted: np.ndarray | None) -> DataFrame:
    """(id, hash, place, slots) of the documents' windows, or of those wanted."""
    near = None
    if wanted is not None:
        near = np.zeros(1 << 20, bool)
        near[(wanted >> np.uint64(44)).astype(np.int64)] = True

    def fn(part, texts):
        doc, code, value, slot = tokens(texts)
        base = kernel.offsets(doc, len(texts))
        plain_doc, plain_code = plain_tokens(texts)
        plain_base = kernel.offsets(plain_doc, len(texts))
        none = np.zeros(len(plain_code), bool)
        out = []
        for size, kind in sizes:
            plain = kind == PLAINLY
            at, h = plain_windows(plain_doc, plain_code, size) if plain else (rich_windows if kind == RICHLY else windows)(doc, code, slot, size)
            if wanted is not None:
                keep = near[(h >> np.uint64(44)).astype(np.int64)]
                at, h = at[keep], h[keep]
                keep = np.isin(h, wanted)
                at, h = at[keep], h[keep]
            if len(at):
                of = (plain_doc, plain_code, none, at, h, size, plain_base) if plain else (doc, value, slot, at, h, size, base)
                out.append(_rows(part.column(0), *of))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    rows = docs.selectExpr("cast(doc_id as long) id", "text").where("id is not null and text is not null")
    return rows.mapInArrow(kernel.per_slice(fn), _SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, rich: int = RICH, coverage: float = COVERAGE, consistency: float = CONSISTENCY, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage) of contaminated documents."""
    items = scratch.table(benchmark_windows(benchmark, window, least, rich).dropDuplicates(["id", "hash", "place"]))
    sizes = sorted((r["size"], r["kind"]) for r in items.select("size", "kind").distinct().collect())
    hashes = items.select("hash").distinct()
    wanted = None
    if hashes.count() <= most_sent:
        wanted = np.sort(hashes.toArrow()["hash"].to_numpy().astype(np.uint64))
    found = document_windows(docs, sizes, wanted)
    right = items.select("hash", "kind", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = found.join(right, "hash").select(F.col("id").alias("doc_id"), "item_id", "kind", "hash", (F.col("place") - F.col("item_place")).alias("shift"), F.arrays_zip(F.col("item_slots").alias("p"), F.col("slots").alias("q")).alias("pairs"))
    bare = F.when(F.size("pairs") == 0, F.col("hash"))  # nulls are not collected
    runs = met.groupBy("doc_id", "item_id", "kind", "shift").agg(F.collect_set("hash").alias("hashes"), F.collect_set(bare).alias("bare"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    kinds = lambda c: F.size(F.array_distinct(F.transform("pairs", lambda x: x[c])))
    paired = F.least(kinds("p"), kinds("q"))
    fit = (paired >= consistency * F.size("pairs")) | (paired >= F.size("pairs") - 1)
    hits = runs.withColumn("passed", F.when(fit, F.col("hashes")).otherwise(F.col("bare"))).where(F.size("passed") > 0)
    hits = hits.groupBy("doc_id", "item_id", "kind").agg(F.size(F.array_distinct(F.flatten(F.collect_list("passed")))).cast("long").alias("matched"))
    total = items.groupBy(F.col("id").alias("item_id"), "kind").agg(F.countDistinct("hash").alias("windows"))
    out = hits.join(total, ["item_id", "kind"]).withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= coverage)
    # the figures of template windows, then of plain ones, then of rich ones
    one = out.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("matched", "windows", "coverage"), "kind").alias("x"))
    return one.select("doc_id", "item_id", "x.matched", "x.windows", "x.coverage")


def remove(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that are not contaminated; columns as they were."""
    bad = scratch.table(contaminated(docs, benchmark, **parameters).select(F.col("doc_id").alias("__gone")).distinct())
    # ids of up to MOST_GONE bytes go to the texts; with more, both meet in a shuffle
    return docs.join(scratch.sent(bad, MOST_GONE), docs["doc_id"] == F.col("__gone"), "left_anti")
