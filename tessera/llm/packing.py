"""Best-fit packing of documents into bins of a fixed number of tokens.

Tokens are those of ``token_count`` (unigram pieces of a public vocabulary), so a
bin fits a context of as many.  Documents are cut into pieces of at most ``capacity`` tokens.  A piece above one
third of the capacity is large: a bin takes at most two of those, matched
greedily, the longest first, each with the longest other that still fits.  The
smaller pieces then go, longest first, into the tightest gap that takes them,
and into a new bin where none does.

Only the number of pieces of each length matters for that, so the plan is made
on the driver from at most ``capacity`` counts, however many documents there
are, in steps that place many equal pieces at once.  It comes out as runs: the
pieces of one length from one ordinal to another go, so many to a bin, into
consecutive bins.  Ordinals are given in parallel: rows are numbered within
(length, hash bucket) and the buckets' counts are added up.

``start`` and ``n_tokens`` of a piece are in tokens of its document.  Defined
results: a null or empty text has no tokens; it gives one row with ``n_tokens`` 0
and a null bin.
Repeated rows and equal lengths are numbered by (doc_id, piece), nulls first,
and each row is packed.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import scratch, token_count

CAPACITY = 2048
_BUCKETS = 1024


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first ordinal, pieces, pieces a bin, first bin, offset).

    Piece ``first + i`` of the length goes into bin ``first bin + i // m`` at
    ``offset + (i % m) * length``, where m is the number of pieces a bin.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    placed: dict[int, int] = defaultdict(int)
    runs, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)

    def put(length: int, pieces: int, m: int, first: int, gap: int) -> None:
        runs.append((length, placed[length], pieces, m, first, capacity - gap))
        placed[length] += pieces

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    # partner[n]: the longest length <= n that still has large pieces
    for a in large:
        while left.get(a):
            b = next((x for x in large if x <= min(a, capacity - a) and left.get(x, 0) > (x == a)), None) if 3 * (capacity - a) > capacity else None
            if b is None:
                n = left.pop(a)
                put(a, n, 1, bins, capacity)
                gap = capacity - a
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                if a == b:
                    runs.append((a, placed[a], 2 * n, 2, bins, 0))
                    placed[a] += 2 * n
                else:
                    put(a, n, 1, bins, capacity)
                    put(b, n, 1, bins, capacity - a)
                left[a] -= n
                left[b] -= n
                gap = capacity - a - b
            if gap:
                gaps[gap].append((bins, n))
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        sizes = [g for g in gaps if g >= s]
        order: list[int] = []
        for g in sizes:
            heappush(order, g)
        while n:
            while order and not gaps.get(order[0]):
                gaps.pop(heappop(order), None)
            if order:
                g = order[0]
                first, many = gaps[g].pop()
            else:
                g = capacity
                first, many = bins, -(-n // (capacity // s))
                bins += many
            m = g // s
            full = min(many, n // m)
            if full:
                put(s, full * m, m, first, g)
                n -= full * m
                if g - m * s:
                    gaps[g - m * s].append((first, full))
            rest = 0
            if n and full < many:
                rest = n
                put(s, n, m, first + full, g)
                n = 0
                gaps[g - rest * s].append((first + full, 1))
            unused = many - full - (rest > 0)
            if unused:
                gaps[g].append((first + many - unused, unused))
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: token_count.Vocabulary | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset) of every piece."""
    lengths = token_count.token_counts(docs, vocabulary).withColumnRenamed("n_tokens", "total")
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0))
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("total") - start).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_BUCKETS)).cast("int").alias("bucket"))
    pieces = scratch.table(pieces)
    # at most capacity * _BUCKETS counts, however long the table
    by = pieces.where("n_tokens > 0").groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    by = by.withColumn("before", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("n"))
    totals = {r["n_tokens"]: r["n"] for r in by.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(totals, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    firsts = (table[:, 0].astype(np.int64) << 46) | table[:, 1]  # sorted by length and ordinal

    def place(batches):
        for batch in batches:
            n, ordinal = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 4))
            run = table[np.searchsorted(firsts, (n << 46) | ordinal, side="right") - 1]
            within = ordinal - run[:, 1]
            bin_id, offset = run[:, 4] + within // run[:, 3], run[:, 5] + within % run[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bin_id), pa.array(offset)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset"])

    schema = "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long"
    inside = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    numbered = pieces.where("n_tokens > 0").withColumn("at", F.row_number().over(inside) - 1).join(by.select("n_tokens", "bucket", "before"), ["n_tokens", "bucket"])
    packed = numbered.select("doc_id", "piece", "start", "n_tokens", (F.col("before") + F.col("at")).cast("long").alias("ordinal")).mapInArrow(place, schema)
    none = F.lit(None).cast("long")
    return packed.unionByName(pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", none.alias("bin_id"), none.alias("bin_offset")))
