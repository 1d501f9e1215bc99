"""Unigram token counts by a Viterbi search that keeps only score and count.

Normaliser, as the vocabulary file's own: code points as they are, each blank
becomes U+2581, and one U+2581 is put before every text that isn't empty.  Texts
are cut before those blanks that no piece crosses: a piece with a blank inside
keeps the blank with what stands before it.  An Aho-Corasick automaton enumerates
the vocabulary's matches in the distinct words of a slice of texts, and dynamic
programming goes over all those words at once, position by position.
It carries for each position the best score and the number of pieces on the way
there, never the pieces.

Rules as in the public Unigram encoder of the ``tokenizers`` library: scores are
added as 64-bit floats from left to right; of equal scores the piece that starts
first (the longest) wins; a character that is no piece of its own may be unknown
at the lowest score less 10; with byte fallback an unknown character counts as
its UTF-8 bytes, without it neighbouring unknowns count as one piece.  Sums begin
anew at each cut, which changes nothing where sums are exact, as they are with
the whole-number scores of ``VOCABULARY``.

The vocabulary is read from a SentencePiece model file on the driver and sent
along, so only the driver needs the file.  Control pieces are
left out, and byte pieces match no text.

A text of any length is counted whole, in blocks that end at cuts; a word of any
length needs memory for its longest piece only.  Defined results: a null or empty
text has 0 tokens; each input row gives one output row; a null ``doc_id`` stays
null; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernel

BLANK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_LONG = 64
_BLOCK = 1 << 20
_CACHE_BITS = 20
_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with their scores; the first one stands for the unknown."""

    pieces: list[str]
    scores: list[float]
    byte_fallback: bool = False
    _built: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "byte_fallback": self.byte_fallback, "_built": None}

    def built(self) -> tuple:
        """(automaton, lengths, scores, cache keys, cache counts, characters after
        which a blank may lie inside a piece)."""
        if self._built is None:
            auto = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                if p:
                    auto.add_word(p, i)
            auto.make_automaton()
            lengths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
            cache = np.zeros(1 << _CACHE_BITS, np.uint64), np.zeros(1 << _CACHE_BITS, np.int32)
            inner = {ord(a) for p in self.pieces for a, b in zip(p, p[1:]) if b == BLANK}
            self._built = (auto, lengths, np.asarray(self.scores, np.float64), *cache, np.array(sorted(inner), np.uint32))
        return self._built


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) or sp.is_unknown(i))]
    return Vocabulary(["<unk>", *(sp.id_to_piece(i) for i in ids)], [0.0, *(sp.get_score(i) for i in ids)], any(sp.is_byte(i) for i in range(sp.get_piece_size())))


def _matches(words: str, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(end, piece) of each match in the text."""
    auto = vocabulary.built()[0]
    flat = np.fromiter(chain.from_iterable(auto.iter(words)), np.int64)
    return flat[0::2] + 1, flat[1::2]


def _bytes(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


def count_words(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Pieces of each word."""
    _, lengths, scores, *_ = vocabulary.built()
    unknown = float(scores.min()) - _PENALTY
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    for i in np.flatnonzero(size > _LONG):
        out[i] = _count_one(words[i], vocabulary, unknown)
    short = np.flatnonzero((size <= _LONG) & (size > 0))
    if not len(short):
        return out
    size = size[short]
    start = np.concatenate(([0], np.cumsum(size)))
    text = "".join([words[i] for i in short])
    end, piece = _matches(text, vocabulary)
    begin = end - lengths[piece]
    word_of = np.repeat(np.arange(len(short)), size)
    inside = word_of[begin] == word_of[end - 1]  # none across neighbouring words
    begin, end, piece = begin[inside], end[inside], piece[inside]
    # every word has one slot more than it has characters
    single = np.zeros(start[-1], bool)
    single[begin[end - begin == 1]] = True
    lost = np.flatnonzero(~single)
    begin, end = np.concatenate((begin, lost)), np.concatenate((end, lost + 1))
    gain = np.concatenate((scores[piece], np.full(len(lost), unknown)))
    unk = np.concatenate((piece == 0, np.ones(len(lost), bool)))
    many = np.ones(len(unk), np.int64)
    if vocabulary.byte_fallback:
        many[len(piece) :] = _bytes(text)[lost]
        unk[:] = False  # nothing merges
    word = word_of[begin]
    local = end - start[word]
    order = np.argsort((local << 52) | (word << 20) | (begin - start[word]))
    begin, end, gain, unk, many, word, local = (x[order] for x in (begin, end, gain, unk, many, word, local))
    best = np.zeros(start[-1] + len(short))
    count = np.zeros(len(best), np.int64)
    last_unknown = np.zeros(len(best), bool)
    bounds = np.searchsorted(local, np.arange(1, local[-1] + 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        w = word[a:b]
        from_ = begin[a:b] + w
        score = best[from_] + gain[a:b]
        new = np.concatenate(([True], w[1:] != w[:-1]))
        segment = np.cumsum(new) - 1
        top = np.maximum.reduceat(score, np.flatnonzero(new))
        at = np.flatnonzero(score == top[segment])
        s = segment[at]
        at = at[np.concatenate(([True], s[1:] != s[:-1]))]  # the earliest start
        to, back, u = end[a:b][at] + w[at], from_[at], unk[a:b][at]
        best[to] = score[at]
        count[to] = count[back] + many[a:b][at] * ~(u & last_unknown[back])
        last_unknown[to] = u
    out[short] = count[start[1:] + np.arange(len(short))]
    return out


def _count_one(word: str, vocabulary: Vocabulary, unknown: float) -> int:
    """The same for one long word, in a ring of as many places as the longest piece has."""
    auto, lengths, scores, *_ = vocabulary.built()
    ring = int(lengths.max()) + 1
    best, count, last = [0.0] * ring, [0] * ring, [False] * ring
    matches = auto.iter(word)  # by end, the longest first
    end, piece = next(matches, (len(word), 0))
    for pos, character in enumerate(word):
        top, single = None, False
        while end == pos:
            length = len(vocabulary.pieces[piece])
            back = (pos + 1 - length) % ring
            score = best[back] + vocabulary.scores[piece]
            if top is None or score > top:
                top, n, lost = score, count[back] + (not (piece == 0 and last[back])), piece == 0
            single |= length == 1
            end, piece = next(matches, (len(word), 0))
        if not single:
            back = pos % ring
            score = best[back] + unknown
            if top is None or score > top:
                many = len(character.encode("utf-8", "surrogatepass")) if vocabulary.byte_fallback else int(not last[back])
                top, n, lost = score, count[back] + many, not vocabulary.byte_fallback
        here = (pos + 1) % ring
        best[here], count[here], last[here] = top, n, lost
    return count[len(word) % ring]


def _blocks(text: str, vocabulary: Vocabulary) -> list[str]:
    """The text in blocks of about ``_BLOCK`` characters that begin at cuts."""
    inner = set(map(chr, vocabulary.built()[5].tolist()))
    out, begin = [], 0
    while len(text) - begin > _BLOCK and BLANK in vocabulary.pieces:
        at = text.find(BLANK, begin + _BLOCK)
        while at > 0 and text[at - 1] in inner:
            at = text.find(BLANK, at + 1)
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def counts(texts: list, vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each text."""
    marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
    if any(len(t) > _BLOCK for t in marked):
        return np.array([sum(int(_counts([b], vocabulary)[0]) for b in _blocks(t, vocabulary)) for t in marked], np.int64)
    return _counts(marked, vocabulary)


def _counts(marked: list[str], vocabulary: Vocabulary) -> np.ndarray:
    text = "".join(marked)
    if not text:
        return np.zeros(len(marked), np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(codes), bool)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    starts[(np.cumsum(length) - length)[length > 0]] = True
    cut = codes == 0x2581
    cut[1:] &= ~np.isin(codes[:-1], vocabulary.built()[5])
    if BLANK not in vocabulary.pieces:  # an unknown blank merges with its neighbours
        cut[:] = False
    begin = np.flatnonzero(starts | cut)
    end = np.concatenate((begin[1:], [len(codes)]))
    h = kernel.span_hashes(codes, begin, end) | np.uint64(1)
    _, _, _, keys, known, _ = vocabulary.built()
    slot = (h >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
    value = known[slot].astype(np.int64)
    miss = np.flatnonzero(keys[slot] != h)
    if len(miss):
        fresh, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        b, e = begin[miss][first].tolist(), end[miss][first].tolist()
        got = count_words([text[i:j] for i, j in zip(b, e)], vocabulary)
        value[miss] = got[inverse]
        place = (fresh >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        keys[place], known[place] = fresh, got
    total = np.concatenate(([0], np.cumsum(value)))
    ends = np.cumsum(length)
    upto = total[np.searchsorted(begin, ends)]
    return np.diff(np.concatenate(([0], upto)))


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    vocabulary = vocabulary or read_vocabulary()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def fn(part, texts):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(counts(texts, sent.value))], names=["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(kernel.per_slice(fn), "doc_id long, n_tokens long")


def oracle_sql(vocabulary: Vocabulary | None = None) -> str:
    """The query on ``documents`` in DuckDB's SQL: a recursive CTE goes over the
    distinct words of all texts at once, a character a step.

    For vocabularies with byte fallback whose inner blanks follow blanks only, as
    in ``VOCABULARY``: words then begin at blanks after other characters.
    """
    vocabulary = vocabulary or read_vocabulary()
    inner = vocabulary.built()[5]
    if not vocabulary.byte_fallback or set(inner.tolist()) > {ord(BLANK)}:
        raise ValueError("no statement for this vocabulary")
    rows = ",".join("('" + p.replace("'", "''") + f"',{s!r})" for p, s in zip(vocabulary.pieces[1:], vocabulary.scores[1:]))
    unknown = min(vocabulary.scores) - _PENALTY
    longest = max(map(len, vocabulary.pieces))
    return f"""
WITH RECURSIVE v(piece, gain) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT row_number() OVER () AS owner, doc_id::BIGINT AS doc_id, CASE WHEN text <> '' THEN regexp_extract_all('{BLANK}' || replace(text, ' ', '{BLANK}'), '(?s){BLANK}+[^{BLANK}]*') END AS parts FROM documents),
held AS MATERIALIZED (SELECT owner, word, count(*) AS times FROM (SELECT owner, unnest(parts) AS word FROM d) GROUP BY ALL),
words AS MATERIALIZED (SELECT word, length(word) AS size FROM held GROUP BY ALL),
places AS MATERIALIZED (SELECT word, size, unnest(range(size)) AS b FROM words),
met AS MATERIALIZED (SELECT word, b, b + n AS e, gain, 1 AS many FROM (SELECT word, b, n, substr(word, b + 1, n) AS piece FROM (SELECT word, b, unnest(range(1, least({longest}, size - b) + 1)) AS n FROM places)) JOIN v USING (piece)
  UNION ALL SELECT word, b, b + 1, {unknown!r}, strlen(substr(word, b + 1, 1)) FROM places ANTI JOIN v ON v.piece = substr(word, b + 1, 1)),
path AS (SELECT word, size, 0 AS done, [0.0::DOUBLE] AS best, [0::BIGINT] AS n FROM words
  UNION ALL SELECT p.word, any_value(size), p.done + 1, list_append(any_value(best), max(best[b + 1] + gain)), list_append(any_value(n), arg_max(n[b + 1] + many, {{'score': best[b + 1] + gain, 'first': -b}}))
  FROM path p JOIN met m ON m.word = p.word AND m.e = p.done + 1 WHERE p.done < p.size GROUP BY p.word, p.done),
counted AS (SELECT word, n[-1] AS n FROM path WHERE done = size)
SELECT doc_id, coalesce(total, 0)::BIGINT AS n_tokens FROM d LEFT JOIN (SELECT owner, sum(times * n) AS total FROM held JOIN counted USING (word) GROUP BY owner) USING (owner)"""
