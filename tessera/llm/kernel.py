"""Vectorised text primitives shared by the operators of this subpackage.

Texts reach Python in Arrow batches.  Everything here works on the code points
of many texts at once, so the cost per character is a handful of numpy passes
instead of interpreted steps.  Memory is bounded by slicing batches to about
``SLICE_CHARS`` characters; a longer single text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_CHARS = 400_000

OTHER, SPACE, DIGIT, LOWER, UPPER, NEWLINE = 0, 1, 2, 3, 4, 5

_TABLE_SIZE = 0x3000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _class_of(ch: str) -> int:
    if ch in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
        return NEWLINE
    if ch.isspace():
        return SPACE
    if ch.isdecimal():
        return DIGIT
    if ch.isalpha():
        return UPPER if ch != ch.lower() else LOWER
    return OTHER


_TABLE = np.fromiter((_class_of(chr(c)) for c in range(_TABLE_SIZE)), np.uint8, _TABLE_SIZE)


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point.  From U+3000 on, letters are U+3041 to U+DFFF,
    U+F900 to U+FAFF and U+20000 to U+323AF; other such points are OTHER."""
    out = _TABLE[np.minimum(codes, _TABLE_SIZE - 1)]
    high = codes >= _TABLE_SIZE
    if high.any():
        c = codes[high]
        letter = ((c > 0x3040) & (c < 0xE000)) | ((c >= 0xF900) & (c < 0xFB00)) | ((c >= 0x20000) & (c < 0x323B0))
        out[high] = np.where(letter, LOWER, np.where(c == 0x3000, SPACE, OTHER))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Texts:
    """Code points of several texts, each followed by one NUL separator."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        texts = ["" if t is None else t for t in texts]
        if lower:
            texts = [t.lower() for t in texts]
        self.n = len(texts)
        self.lens = np.fromiter(map(len, texts), np.int64, self.n)
        joined = "\0".join(texts) + "\0"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.lens + 1, out=self.starts[1:])
        self.cls = classes(self.codes)
        # a NUL inside a text is of class OTHER as the separators are

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), self.lens + 1)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each pair; depends on the codes only."""
    pw, inv = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pw[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start])


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every run of letters and digits."""
    s, e = spans((texts.cls >= DIGIT) & (texts.cls <= UPPER))
    return np.searchsorted(texts.starts, s, side="right") - 1, s, e


def offsets(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each document's entries begin in a list sorted by document."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=n), out=out[1:])
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose texts hold about ``most`` bytes each."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64) + 16
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def per_slice(fn: Callable[[pa.RecordBatch, list], pa.RecordBatch | None], column: str = "text"):
    """Function for ``mapInArrow`` that applies fn(slice, texts) to small slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch, column):
                    out = fn(part, part.column(part.schema.get_field_index(column)).to_pylist())
                    if out is not None and out.num_rows:
                        yield out

    return run
