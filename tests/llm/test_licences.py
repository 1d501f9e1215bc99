from __future__ import annotations

import math
import textwrap
from collections import Counter

import numpy as np

from tessera.llm import licences as L
from tessera.llm import queries

SCHEMA = "doc_id long, path string, text string, licence string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def words(t):
    return "".join(c if c.isalnum() else " " for c in t.lower()).split()


def test_cosine_equals_a_plain_one():
    texts = ["Licensed under the MIT License.", "the license of the mit the unheard", "nothing here at all", "", "This program is free software under the terms of the GNU General Public License version 3"]
    rng = np.random.default_rng(1)
    df = rng.integers(0, 9, len(L.template_words())).astype(float)
    m = L.matcher(10, df)
    place = {h: i for i, h in enumerate(L.template_words().tolist())}

    def idf(w):
        i = place.get(int(L._tokens([w])[4][0]))
        return math.log(11 / (1 + df[i])) + 1 if i is not None else math.log(11) + 1

    def vector(t):
        return {w: (1 + math.log(c)) * idf(w) for w, c in Counter(words(t)).items()}

    def cosine(a, b):
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    rows = L.templates()
    vectors = [vector(x) for _, _, x in rows]
    _, doc, _, _, h = L._tokens(texts)
    for part, kept in ((m, range(len(rows))), (m.headers(), [i for i, r in enumerate(rows) if not r[1]])):
        u, which, got = L.similarity(doc.astype(np.int64), h, len(texts), part, 0.1)
        want = {(i, k): round(cosine(vector(x), vectors[t]), 6) for i, x in enumerate(texts) if words(x) for k, t in enumerate(kept)}
        assert {p for p, c in want.items() if c >= 0.1} == set(zip(u.tolist(), which.tolist()))
        assert all(abs(want[p] - c) < 2e-6 for *p, c in zip(u.tolist(), which.tolist(), got.tolist()) for p in [tuple(p)])


def wrapped(name):
    return "\n".join(textwrap.wrap(L.full_texts()[name], 72))


def headers(spark, texts):
    rows = [(i, f"d{i}/file", x) for i, x in enumerate(texts)]
    found = L.scan(table(spark, rows).select("doc_id", "path", "text"), L.matcher(*L.document_frequency(table(spark, rows)))).collect()
    by = {r["doc_id"]: (r["header"], r["is_file"], r["cosine"]) for r in found}
    return [by[i] for i in range(len(texts))]


def test_every_full_text_is_found_when_wrapped_and_is_a_licence_file(spark):
    names = sorted(L.full_texts())
    for name, (header, is_file, cosine) in zip(names, headers(spark, [wrapped(n) for n in names])):
        assert (header, is_file) == (name, True) and cosine > 0.99


def test_heads_comments_and_lines_that_only_sound_alike(spark):
    mpl = "x = 1\nthe source code form of the license\ny = 2\nz = x + y"
    head = L.full_texts()["GPL-3.0"][:900]
    apache = textwrap.indent("\n".join(textwrap.wrap(L.HEADERS["Apache-2.0"][3], 40)), "# ") + "\n#\n# " + "\n# ".join(textwrap.wrap(L.HEADERS["Apache-2.0"][4], 40)) + "\n\nimport os\n" + "a = 1\n" * 300
    prose = "The terms of the treaty, and the rights of any person under it, were subject to the conditions of the council.\n" * 20
    short = "Licensed under the MIT License.\nfoo"
    got = headers(spark, [mpl, head, apache.replace("\n", "\r\n"), prose, short])
    assert [g[0] for g in got] == [None, "GPL-3.0", "Apache-2.0", None, "MIT"]
    assert [g[1] for g in got] == [False] * 5  # nothing here is a whole licence


def test_the_most_similar_file_owns_the_directory(spark):
    near = "Licensed under the MIT License. See also the file"
    rows = [(1, "a/LICENSE", near), (2, "a/COPYING", wrapped("GPL-3.0")), (3, "a/x.c", "int x;"), (4, "b/LICENSE", wrapped("MIT")), (5, "b/NOTICE", wrapped("ISC")), (6, "b/y.c", "int y;"), (7, "c/LICENSE", "Released under the MIT License."), (8, "c/LICENCE", "Licensed under CC BY 4.0."), (9, "c/z", "z")]
    got = {r["doc_id"]: r["licence"] for r in L.licences(table(spark, rows)).collect()}
    assert got[3] == "GPL-3.0" and got[6] == "ISC" and got[9] == "CC-BY-4.0"  # equal ones: by name


def test_headers_files_and_nearest_ancestor(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the MIT License."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/y.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code = 1\n" * 60), (5, "z/q.py", "print(2)"), (6, "a2/w.py", "print(3)"), (7, "top.py", "x"),
    ]
    got = {r["doc_id"]: (r["licence"], r["licence_from"]) for r in L.licences(table(spark, rows)).collect()}
    assert got == {1: ("MIT", "header"), 2: ("Apache-2.0", "a/b"), 3: ("Apache-2.0", "header"), 4: ("GPL-3.0", "header"), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "d/f", ""), (None, "d/COPYING", "Released under the MIT License."), (3, "d/h", "word " * 100_000), (3, "d/h", "word " * 100_000), (4, "", "text"), (5, "/", "text"), (6, "LICENSE", "Licensed under CC BY 4.0.")]
    got = L.licences(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["path"]): r["licence"] for r in got}
    assert by[(1, None)] is None and by[(2, "d/f")] == by[(3, "d/h")] == "MIT" and by[(None, "d/COPYING")] == "MIT"
    assert by[(4, "")] == "CC-BY-4.0"  # the directory of files at the top
    assert L.licences(table(spark, rows[:0])).count() == 0


def test_query_keeps_every_row_and_finds_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op7_license_scan(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    by = dict(zip(got.doc_id, got.header))
    for i, t in zip(docs.doc_id, docs.text):
        if "Apache License, Version 2.0" in t:
            assert by[i] is not None
