"""Pieces of the DuckDB statements that results are checked against."""

from __future__ import annotations


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


CORPUS = f"""docs AS (SELECT doc_id, source, {tokens('text')} AS tokens FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL),
lens AS (SELECT doc_id, source, len(tokens) AS dl FROM docs),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
rawidf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), tot),
flo AS (SELECT 0.25 * avg(raw) AS floor FROM rawidf),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM rawidf, flo)"""

ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


def asked(queries: str = ITEMS, name: str = "asked") -> str:
    return f"{name} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM ({queries})) GROUP BY ALL)"


def scored(name: str = "scored", k1: float = 1.5, b: float = 0.75, terms: str = "asked") -> str:
    return f"""{name} AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * ({1 - b} + {b} * dl / avgdl))), 6) AS score
FROM {terms} JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc_id), tot GROUP BY query_id, doc_id)"""


def top(name: str, source: str, k: int, item: str = "doc_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item}) AS rank FROM {source}) WHERE rank <= {k})"


def dedup(name: str, ranked: str, k: int, doc: str = "source") -> str:
    """Best chunk of each document, ranked anew."""
    return f"""{name} AS (SELECT * FROM (SELECT * EXCLUDE (rank, n), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, {doc} ORDER BY rank) AS n FROM {ranked}) WHERE n = 1) WHERE rank <= {k})"""


def fused(name: str, lists: list[str], item: str, k: int) -> str:
    every = " UNION ALL ".join(f"SELECT query_id, {item}, rank, {i} AS list FROM {x}" for i, x in enumerate(lists))
    return f"""{name} AS (SELECT query_id, {item}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, {item}) AS rank FROM
(SELECT query_id, {item}, round(sum(1 / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first FROM ({every}) GROUP BY query_id, {item})) WHERE rank <= {k})"""


GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"

FAMILIES = "fam AS (SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM gold) THEN CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END ELSE 'abstention' END AS family FROM benchmark)"

METRICS = """marked AS (SELECT r.*, g.doc_id IS NOT NULL AS hit FROM runs r LEFT JOIN gold g ON r.query_id = g.query_id AND r.doc_id = g.doc_id),
sizes AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
per AS (SELECT method, m.query_id, coalesce(any_value(n_gold), 0) AS n_gold,
  coalesce(count(DISTINCT doc_id) FILTER (hit AND rank <= 5) / any_value(n_gold), 0) AS recall_5,
  coalesce(count(DISTINCT doc_id) FILTER (hit AND rank <= 10) / any_value(n_gold), 0) AS recall_10,
  coalesce(count(DISTINCT doc_id) FILTER (hit AND rank <= 20) / any_value(n_gold), 0) AS recall_20,
  coalesce(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) / list_sum(list_transform(range(1, least(any_value(n_gold), 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg,
  coalesce(1 / min(rank) FILTER (hit), 0) AS mrr
  FROM marked m LEFT JOIN sizes s ON m.query_id = s.query_id GROUP BY method, m.query_id)"""


def statement(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
