"""Licence scan: sparse TF-IDF cosine to templates, then directory inheritance.

Templates are the full public licence texts in ``licence_texts`` and the headers
below.  Units of a text are its lines, its paragraphs (runs of lines with words,
so that a header wrapped over comment lines is one unit) and the whole.  Lines
and paragraphs are compared with the headers, the whole with headers and full
texts, by the cosine of vectors of (1 + ln count) * idf; the document frequencies
of the templates' words are counted over all texts.  Cosines are rounded to six
places, so that equal ones tie.  A text's header is the licence of its most
similar unit, if that reaches ``threshold``; ``cosine`` is that unit's.

A text with a header is a licence file if its name says so, if the whole of it
reaches the threshold against a full licence text, or if matching lines, or
matching paragraphs, make up ``share`` of its characters and have ``least_words``
words: one short line makes no licence file.

A file without a header takes the licence of its nearest ancestor directory that
holds a licence file: paths are expanded into their ancestor directories, joined
with the licensed directories, and the longest match is kept.

Defined results: null and empty texts have no header.  A null path is in no
directory and inherits nothing.  Of equally similar templates the first by name
wins; of several licence files in a directory the most similar, then the one with
the least licence name and id.  Each input
row gives one output row (rows that share a path and id alike); a null
``doc_id`` stays null.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel, scratch

THRESHOLD = 0.75
SHARE = 0.3
LEAST_WORDS = 10
PLACES = 6
FILE = r"(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"
_FILE = re.compile(FILE, re.I)

HEADERS: dict[str, list[str]] = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal", "Released under CC0 1.0 Universal, dedicated to the public domain."],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["ISC License", "Licensed under the ISC License."],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla org MPL 2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["zlib License", "Licensed under the zlib License."],
}


def full_texts() -> dict[str, str]:
    """The licence texts that come with the package, by name."""
    return {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def templates() -> list[tuple[str, bool, str]]:
    """(licence, whether it is a full text, text), in the order of names."""
    rows = [(k, False, x) for k, xs in HEADERS.items() for x in xs] + [(k, True, x) for k, x in full_texts().items()]
    return sorted(rows, key=lambda r: r[:2])


def _tokens(texts: list) -> tuple[kernel.Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = kernel.Texts(texts, lower=True)
    doc, s, e = kernel.words(t)
    return t, doc, s, e, kernel.span_hashes(t.codes, s, e)


@dataclass
class Matcher:
    """Template vectors over their words; ``idf`` has one more entry for others."""

    names: list[str]  # of each template
    full: np.ndarray  # whether each is a full text
    words: np.ndarray  # sorted hashes
    idf: np.ndarray
    vectors: np.ndarray  # word x template, columns of unit length

    def headers(self) -> "Matcher":
        """The same without the full texts, and without words that only they have."""
        own = ~self.full
        used = (self.vectors[:, own] != 0).any(1)
        kept = Matcher([n for n, f in zip(self.names, self.full) if not f], self.full[own], self.words[used], np.append(self.idf[:-1][used], self.idf[-1]), self.vectors[used][:, own])
        kept.others = self.words[~used], self.idf[:-1][~used]
        return kept

    others: tuple | None = None  # words of no vector here that have an idf of their own


def template_words() -> np.ndarray:
    return np.unique(_tokens([x for _, _, x in templates()])[4])


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, texts that hold each template word), over all texts."""
    words = template_words()

    def fn(batches):
        n, df = 0, np.zeros(len(words), np.int64)
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                texts = part.column(0).to_pylist()
                _, doc, _, _, h = _tokens(texts)
                at = np.searchsorted(words, h)
                hit = words[np.minimum(at, len(words) - 1)] == h
                key = np.unique(doc[hit] * len(words) + at[hit])
                df += np.bincount(key % len(words), minlength=len(words))
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], np.arange(len(words))))), pa.array(np.concatenate(([n], df)))], names=["word", "n"])

    rows = docs.where("text is not null").select("text").mapInArrow(fn, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(words))], float)


def matcher(n: int, df: np.ndarray) -> Matcher:
    rows, words = templates(), template_words()
    idf = np.append(np.log((1 + n) / (1 + df)) + 1, np.log(1.0 + n) + 1)
    vectors = np.zeros((len(words), len(rows)))
    _, doc, _, _, h = _tokens([x for _, _, x in rows])
    np.add.at(vectors, (np.searchsorted(words, h), doc), 1)
    vectors[vectors > 0] = 1 + np.log(vectors[vectors > 0])
    vectors *= idf[:-1, None]
    vectors /= np.linalg.norm(vectors, axis=0)
    return Matcher([k for k, _, _ in rows], np.array([f for _, f, _ in rows]), words, idf, vectors)


def similarity(unit: np.ndarray, h: np.ndarray, n: int, m: Matcher, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, template, cosine) of all pairs that reach the threshold, of n units
    made of the words h."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(h):
        return none
    at = np.searchsorted(m.words, h)
    hit = m.words[np.minimum(at, len(m.words) - 1)] == h
    # a unit near a template has a word of it
    some = np.zeros(n, bool)
    some[unit[hit]] = True
    keep = some[unit]
    if not keep.any():
        return none
    unit, h, at, hit = unit[keep], h[keep], at[keep], hit[keep]
    pair = kernel.mix(h ^ kernel.mix(unit.astype(np.uint64) + np.uint64(1)))
    _, first, count = np.unique(pair, return_index=True, return_counts=True)
    back = np.argsort(first)
    first, count = first[back], count[back]  # by unit again, as units come in order
    u, h, at, hit = unit[first], h[first], at[first], hit[first]
    idf = np.where(hit, m.idf[np.where(hit, at, len(m.words))], m.idf[-1])
    if m.others is not None:
        other = np.minimum(np.searchsorted(m.others[0], h), len(m.others[0]) - 1)
        known = ~hit & (m.others[0][other] == h)
        idf[known] = m.others[1][other[known]]
    weight = (1 + np.log(count)) * idf
    norm = np.sqrt(np.bincount(u, weight**2, minlength=n))
    u, at, weight = u[hit], at[hit], weight[hit]
    begin = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    dot = np.add.reduceat(m.vectors[at] * weight[:, None], begin, axis=0)
    cosine = np.round(dot / norm[u[begin], None], PLACES)
    row, column = np.nonzero(cosine >= threshold)
    return u[begin][row], column, cosine[row, column]


def _lines(t: kernel.Texts, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, paragraph) of the lines that have a word, given the
    words' starts.  A line feed after a carriage return ends no line of its own."""
    ends = t.cls == kernel.NEWLINE
    ls, le = kernel.spans(~(ends | (t.codes == 0)))
    worded = np.unique(np.searchsorted(ls, s, side="right") - 1)
    ls, le = ls[worded], le[worded]
    ends[1:] &= (t.codes[1:] != 10) | (t.codes[:-1] != 13)
    number = np.concatenate(([0], np.cumsum(ends)))[ls]
    of = np.searchsorted(t.starts, ls, side="right") - 1
    fresh = np.ones(len(ls), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (np.diff(number) > 1)
    return ls, le, of, np.cumsum(fresh) - 1


def _scan_texts(texts: list, m: Matcher, threshold: float, share: float, least_words: int) -> tuple[list, list, np.ndarray]:
    """(header, its cosine, whether the text alone makes a licence file)."""
    n = len(texts)
    t, doc, s, e, h = _tokens(texts)
    names, scores, is_file = [None] * n, [None] * n, np.zeros(n, bool)
    if not len(h):
        return names, scores, is_file
    heads = m.headers()
    head_names, all_names = np.array(heads.names), np.array(m.names)
    ls, le, line_doc, paragraph = _lines(t, s)
    line = np.searchsorted(ls, s, side="right") - 1
    found_doc, found_name, found_cosine = [], [], []
    for unit_of_line in (np.arange(len(ls)), paragraph):
        size = unit_of_line[-1] + 1
        unit_doc = np.zeros(size, np.int64)
        unit_doc[unit_of_line] = line_doc
        u, which, cosine = similarity(unit_of_line[line], h, size, heads, threshold)
        found_doc.append(unit_doc[u])
        found_name.append(head_names[which])
        found_cosine.append(cosine)
        matching = np.zeros(size, bool)
        matching[u] = True
        inside = matching[unit_of_line]
        covered = np.bincount(line_doc[inside], (le - ls)[inside], minlength=n)
        words = np.bincount(doc[inside[line]], minlength=n)
        is_file |= (covered >= share * np.maximum(t.lens, 1)) & (words >= least_words)
    u, which, cosine = similarity(doc.astype(np.int64), h, n, m, threshold)
    found_doc.append(u)
    found_name.append(all_names[which])
    found_cosine.append(cosine)
    is_file[u[m.full[which]]] = True
    found_doc, found_name, found_cosine = (np.concatenate(x) for x in (found_doc, found_name, found_cosine))
    for i in np.lexsort((found_name, -found_cosine)):
        d = found_doc[i]
        if names[d] is None:
            names[d], scores[d] = str(found_name[i]), float(found_cosine[i])
    return names, scores, is_file


def scan(files: DataFrame, m: Matcher, threshold: float = THRESHOLD, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, path, header, cosine, is_file) for every row."""

    def fn(part, texts):
        header, scores, is_file = _scan_texts(texts, m, threshold, share, least_words)
        named = [bool(_FILE.search(p or "")) for p in part.column(1).to_pylist()]
        files_ = [h is not None and (a or bool(b)) for h, a, b in zip(header, named, is_file)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(header, pa.string()), pa.array(scores, pa.float64()), pa.array(files_, pa.bool_())], names=["doc_id", "path", "header", "cosine", "is_file"])

    return files.selectExpr("cast(doc_id as long) doc_id", "path", "text").mapInArrow(kernel.per_slice(fn), "doc_id long, path string, header string, cosine double, is_file boolean")


def licences(files: DataFrame, threshold: float = THRESHOLD, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, path, header, cosine, licence, licence_from) for every row.

    ``licence_from`` is 'header', the directory the licence comes from, or null.
    """
    n, df = document_frequency(files)
    found = scratch.table(scan(files, matcher(n, df), threshold, share, least_words))
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    owners = found.where("is_file and path is not null").select(F.when(F.instr("path", "/") > 0, parent).otherwise("").alias("dir"), (-F.col("cosine")).alias("far"), "header", "doc_id")
    owners = owners.groupBy("dir").agg(F.min(F.struct("far", "header", "doc_id")).alias("least")).select("dir", F.col("least.header").alias("dir_licence"))
    # distinct directories of files, not files, are expanded into ancestors
    homes = found.where("path is not null").select(F.when(F.instr("path", "/") > 0, parent).otherwise("").alias("home")).distinct()
    steps = F.split("home", "/")
    up = homes.select("home", F.explode(F.when(F.col("home") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(F.split(F.col("home"), "/"), F.lit(1), i), "/")))).alias("dir"))
    nearest = up.join(owners, "dir").groupBy("home").agg(F.max_by(F.struct("dir", "dir_licence"), F.length("dir")).alias("got"))
    home = F.when(F.instr("path", "/") > 0, parent).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    out = found.withColumn("home", home).join(nearest, "home", "left")
    licence = F.coalesce("header", "got.dir_licence")
    origin = F.when(F.col("header").isNotNull(), F.lit("header")).otherwise(F.col("got.dir"))
    return out.select("doc_id", "path", "header", "cosine", licence.alias("licence"), origin.alias("licence_from"))


def _quoted(text: str) -> str:
    return "'" + " ".join(text.split()).replace("'", "''") + "'"


def oracle_sql() -> str:
    """The query on ``documents`` in DuckDB's SQL, whose paths are source/lang/doc_id."""
    rows = ",\n".join(f"({i}, '{k}', {f}, {_quoted(x)})" for i, (k, f, x) in enumerate(templates()))
    word = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+')"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id::BIGINT AS doc_id, concat_ws('/', source, lang, doc_id) AS path, text, row_number() OVER () AS rid FROM documents),
made(tid, licence, complete, body) AS (VALUES {rows}),
tw AS MATERIALIZED (SELECT tid, licence, complete, word, count(*) AS c FROM (SELECT tid, licence, complete, unnest({word.format("body")}) AS word FROM made) GROUP BY ALL),
cut AS (SELECT rid, string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM d WHERE text IS NOT NULL),
lines AS (SELECT rid, unnest(parts) AS line, unnest(range(len(parts))) AS nth FROM cut),
worded AS (SELECT rid, nth, length(line) AS size, {word.format("line")} AS words FROM lines WHERE len({word.format("line")}) > 0),
fresh AS (SELECT *, CASE WHEN nth - lag(nth) OVER (PARTITION BY rid ORDER BY nth) = 1 THEN 0 ELSE 1 END AS new FROM worded),
paragraphs AS MATERIALIZED (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY nth) AS par FROM fresh),
w AS MATERIALIZED (SELECT rid, nth, par, unnest(words) AS word FROM paragraphs),
total AS (SELECT count(*) AS n FROM d WHERE text IS NOT NULL),
df AS (SELECT word, count(DISTINCT rid) AS df FROM w SEMI JOIN tw USING (word) GROUP BY word),
idf AS MATERIALIZED (SELECT word, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word) CROSS JOIN total),
raised AS (SELECT tid, licence, complete, word, (1 + ln(c)) * idf AS v FROM tw JOIN idf USING (word)),
tv AS MATERIALIZED (SELECT tid, licence, complete, word, v / sqrt(sum(v * v) OVER (PARTITION BY tid)) AS v FROM raised),
u AS (SELECT 'l' AS kind, rid, nth AS unit, word, count(*) AS c FROM w GROUP BY ALL
      UNION ALL SELECT 'p', rid, par, word, count(*) FROM w GROUP BY ALL
      UNION ALL SELECT 'w', rid, 0, word, count(*) FROM w GROUP BY ALL),
uw AS MATERIALIZED (SELECT kind, rid, unit, word, (1 + ln(c)) * coalesce(idf, ln(1 + n) + 1) AS v FROM u LEFT JOIN idf USING (word) CROSS JOIN total),
norm AS (SELECT kind, rid, unit, sqrt(sum(v * v)) AS s FROM uw GROUP BY ALL),
dots AS (SELECT kind, rid, unit, tid, licence, complete, sum(uw.v * tv.v) AS dot FROM uw JOIN tv USING (word) WHERE kind = 'w' OR NOT complete GROUP BY ALL),
hits AS MATERIALIZED (SELECT * FROM (SELECT kind, rid, unit, licence, complete, round(dot / s, {PLACES}) AS cosine FROM dots JOIN norm USING (kind, rid, unit)) WHERE cosine >= {THRESHOLD}),
best AS (SELECT rid, licence AS header, cosine FROM hits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, licence) = 1),
covered AS (SELECT kind, p.rid, sum(size) AS size, sum(len(words)) AS words FROM paragraphs p JOIN (SELECT DISTINCT kind, rid, unit FROM hits WHERE kind <> 'w') h ON p.rid = h.rid AND h.unit = CASE kind WHEN 'l' THEN p.nth ELSE p.par END GROUP BY ALL),
filed AS (SELECT rid FROM covered JOIN d USING (rid) WHERE covered.size >= {SHARE} * greatest(length(text), 1) AND words >= {LEAST_WORDS} UNION SELECT rid FROM hits WHERE complete),
found AS MATERIALIZED (SELECT doc_id, path, header, cosine, header IS NOT NULL AND (coalesce(regexp_matches(path, '{FILE}', 'i'), false) OR rid IN (SELECT rid FROM filed)) AS is_file,
  CASE WHEN instr(path, '/') > 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN path IS NOT NULL THEN '' END AS home FROM d LEFT JOIN best USING (rid)),
owners AS (SELECT home AS dir, header AS owned FROM found WHERE is_file AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY home ORDER BY -cosine, header, doc_id NULLS FIRST) = 1),
up AS (SELECT home, unnest(range(len(string_split(home, '/')) + 1)) AS depth FROM (SELECT DISTINCT home FROM found WHERE home IS NOT NULL)),
nearest AS (SELECT up.home, arg_max(dir, depth) AS dir, arg_max(owned, depth) AS owned FROM up JOIN owners ON dir = array_to_string(string_split(up.home, '/')[1:depth], '/') GROUP BY up.home)
SELECT doc_id, path, header, cosine, coalesce(header, owned) AS licence, CASE WHEN header IS NOT NULL THEN 'header' ELSE dir END AS licence_from FROM found LEFT JOIN nearest USING (home)"""
