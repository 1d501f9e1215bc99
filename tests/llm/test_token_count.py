from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm import token_count as C

WORDS = C.Vocabulary(["<unk>", C.BLANK, "a", "b", "ab", "ba", "aba", C.BLANK + "a", "bb", "abab"], [0.0, -2.0, -1.5, -1.5, -2.5, -3.0, -4.0, -2.5, -3.0, -5.0])


def plain(text, vocabulary):
    """Every split of the text by dynamic programming, ties to the longest."""
    t = (text or "").replace(" ", C.BLANK)
    if not t:
        return 0
    t = C.BLANK + t
    score = {p: s for p, s in zip(vocabulary.pieces[1:], vocabulary.scores[1:])}
    low = min(vocabulary.scores) - C._PENALTY
    total, begin = 0, 0
    ends = [i for i in range(1, len(t)) if t[i] == C.BLANK] + [len(t)]
    for end in ends:
        w, begin = t[begin:end], end
        best = [(0.0, 0, False)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                p = w[i:j]
                if p in score:
                    s, u = best[i][0] + score[p], False
                elif j - i == 1:
                    s, u = best[i][0] + low, True
                else:
                    continue
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, best[i][1] + (not (u and best[i][2])), u)
        total += best[-1][1]
    return total


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab cé", max_size=90), max_size=5))
def test_counts_equal_plain_dynamic_programming(texts):
    assert C.counts(texts, WORDS).tolist() == [plain(t, WORDS) for t in texts]


def uncut(text, vocabulary):
    """Every split of the whole text; unknown characters count as their bytes."""
    t = (text or "").replace(" ", C.BLANK)
    if not t:
        return 0
    t = C.BLANK + t
    score = dict(zip(vocabulary.pieces[1:], vocabulary.scores[1:]))
    longest = max(map(len, vocabulary.pieces))
    low = min(vocabulary.scores) - C._PENALTY
    best = [(0.0, 0)]
    for j in range(1, len(t) + 1):
        ways = [(best[i][0] + score[t[i:j]], -i, best[i][1] + 1) for i in range(max(0, j - longest), j) if t[i:j] in score]
        if t[j - 1] not in score:
            ways.append((best[j - 1][0] + low, 1 - j, best[j - 1][1] + len(t[j - 1].encode())))
        s, _, n = max(ways)
        best.append((s, n))
    return best[-1][1]


def test_blank_runs_and_unknown_bytes_equal_the_uncut_search():
    v = C.read_vocabulary()
    assert v.byte_fallback
    code = "def f(x):\n    if x:\n        return  [1,   2]\n\n\n" + " " * 37 + "end  "
    texts = ["a" + " " * 4 + "b", "  ", "", None, " " * 300, code, "a\n\n\nb\t\tc", "smile \U0001f600\U0001f680 \u2603 x", "\U00020000" * 90, code * 30, "  last ", " first"]
    assert C.counts(texts, v).tolist() == [uncut(t, v) for t in texts]
    assert C.counts(["a" + " " * 4 + "b"], v)[0] == 3


CROSSING = C.Vocabulary(["<unk>", C.BLANK, "a", "b", C.BLANK * 2, "a" + C.BLANK + "b", "b" + C.BLANK, C.BLANK + "a"], [0.0, -2.0, -1.5, -1.5, -2.5, -3.0, -2.0, -2.5], True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab cé", max_size=90), max_size=5))
def test_pieces_across_blanks_equal_the_uncut_search(texts):
    assert C.counts(texts, CROSSING).tolist() == [uncut(t, CROSSING) for t in texts]


def test_equal_scores_take_the_longest_last_piece():
    v = C.Vocabulary(["<unk>", C.BLANK, "a", "aa", "aaa"], [0.0, -1.0, -1.0, -2.0, -3.0])
    for n in range(1, 12):
        assert C.counts(["a" * n], v)[0] == plain("a" * n, v)


def test_long_words_and_a_full_cache():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(500)), "b" * 3000] + [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(10)]
    assert C.counts(texts, WORDS).tolist() == [plain(t, WORDS) for t in texts]
    assert C.counts(texts, WORDS).tolist() == [plain(t, WORDS) for t in texts]  # from the cache


def test_awkward_rows(spark, awkward, make_docs):
    v = C.read_vocabulary()
    rows = C.token_counts(awkward, v).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert by[1] == by[2] == 0 and by[5] == by[6] > 0 and by[4] > 90_000
    assert C.token_counts(make_docs([]), v).count() == 0


def encoder(vocabulary):
    """The library's own Unigram encoder over the same pieces; nothing is trained."""
    from tokenizers import Tokenizer, models

    pieces = list(zip(vocabulary.pieces, vocabulary.scores))
    if vocabulary.byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=vocabulary.byte_fallback))


def encoded(texts, tokenizer):
    marked = [C.BLANK + t.replace(" ", C.BLANK) if t else "" for t in texts]
    return [len(e.ids) for e in tokenizer.encode_batch(marked, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab cé\n▁😀", max_size=90), max_size=5))
def test_counts_equal_the_library_encoder(texts):
    for v in (WORDS, CROSSING):
        assert C.counts(texts, v).tolist() == encoded(texts, encoder(v))


def test_blank_runs_equal_the_library_encoder_and_the_files_normaliser():
    import sentencepiece

    v = C.read_vocabulary()
    texts = ["a    b", "def f():\n        return 1", " " * 64, " first", "  two", "a ", "x\t\ty", "smile 😀 ☃", "ﬁ Ⅳ ①", "", "\u00a0\u3000"]
    assert C.counts(texts, v).tolist() == encoded(texts, encoder(v))
    file = sentencepiece.SentencePieceProcessor(model_file=C.VOCABULARY)
    assert [file.normalize(t) for t in texts] == [C.BLANK + t.replace(" ", C.BLANK) if t else "" for t in texts]


def test_blocks_of_a_long_text(monkeypatch):
    v = C.read_vocabulary()
    text = ("some words,   and\n      a run of blanks  " * 40) + "x" * 500 + " end"
    whole = C.counts([text, "a b"], v).tolist()
    assert whole == encoded([text, "a b"], encoder(v))
    for block in (1, 7, 100):
        monkeypatch.setattr(C, "_BLOCK", block)
        assert C.counts([text, "a b"], v).tolist() == whole


def test_query_equals_the_library_encoder_on_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = sorted((r["doc_id"], r["n_tokens"]) for r in queries.op10_token_counts(spark, sf).collect())
    assert got == sorted(zip(docs.doc_id.tolist(), encoded(docs.text.tolist(), encoder(C.read_vocabulary()))))
