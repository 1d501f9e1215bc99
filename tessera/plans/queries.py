"""One query for each operator over the synthetic tables, with its SQL.

documents stand for chunks (their source for the document a chunk belongs to),
benchmark for tasks, orders and lineitem for dated records and citations.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema, store
from tessera.functions import text as T
from tessera.operators import abstention, agent, corpus, dense, filters, fusion, generate, graph, lexical, metrics, sampling, verify
from tessera.plans import sql
from tessera.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from tessera.plans.registry import table as _t
from tessera.sources import export, records


def _chunks(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text", F.col("source").alias("doc_id"))


def _items(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _gold(spark, d) -> DataFrame:
    """Read by several parts of a plan, so written once."""
    return store.written(verify.verbatim(_t(spark, d, "documents").select("doc_id", "text"), _items(spark, d)))


def _runs(spark, d, k: int = 20) -> DataFrame:
    """Two methods, BM25 with either published k1, from one scan of the chunks."""
    items, out = _items(spark, d), None
    lists = lexical.ranked(_chunks(spark, d), items, k, (1.5, 1.2))
    for name, one in zip(("bm25", "bm25_k12"), lists):
        one = one.select(F.lit(name).alias("method"), "query_id", "rank", F.col("pos").alias("doc_id"))
        one = items.select("query_id").withColumn("method", F.lit(name)).join(one, ["method", "query_id"], "left").select("method", "query_id", F.coalesce("rank", F.lit(1)).alias("rank"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


_RUNS = ["runs AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, b.query_id, coalesce(t.rank, 1) AS rank, t.doc_id FROM ({sql.ITEMS}) b LEFT JOIN {t} t ON b.query_id = t.query_id" for m, t in (("bm25", "top_a"), ("bm25_k12", "top_b"))) + ")"]
_TWO = [sql.CORPUS, sql.asked(), sql.scored("sc_a"), sql.scored("sc_b", 1.2)]
_RUN = [*_TWO, sql.top("top_a", "sc_a", 20), sql.top("top_b", "sc_b", 20), *_RUNS]


def _families(spark, d, gold: DataFrame) -> DataFrame:
    items = _items(spark, d).join(gold.select("query_id", F.lit(True).alias("has")).distinct(), "query_id", "left")
    return items.select("query_id", "text", F.when(F.col("has").isNull(), "abstention").when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("family"))


def _scores(spark, d):
    gold = _gold(spark, d)
    return metrics.per_query(_runs(spark, d), gold), _families(spark, d, gold)


# ---- retrieval quality, end to end ----


@query(sql.statement(*_RUN, sql.GOLD, sql.FAMILIES, sql.METRICS, select="""SELECT method, family, n, metric, value FROM (UNPIVOT (
SELECT method, CASE WHEN grouping(family) = 1 THEN 'all' ELSE family END AS family, count(*) AS n, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(recall_20), 4) AS recall_20, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr
FROM per JOIN fam USING (query_id) GROUP BY GROUPING SETS ((method), (method, family))) ON recall_5, recall_10, recall_20, ndcg, mrr INTO NAME metric VALUE value)"""))
def score_report(spark, d):
    scores, families = _scores(spark, d)
    return metrics.aggregate(scores, families, ["recall_5", "recall_10", "recall_20", "ndcg", "mrr"])


@query(sql.statement(*_RUN, sql.GOLD, sql.METRICS, select="SELECT method, query_id, n_gold, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(recall_20, 6) AS recall_20, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM per"))
def ranking_metrics(spark, d):
    scores = metrics.per_query(_runs(spark, d), _gold(spark, d))
    return scores.select("method", "query_id", "n_gold", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "recall_20", "ndcg", "mrr")))


@query(sql.statement(*_RUN, sql.GOLD, sql.METRICS, select="""SELECT 'recall_10' AS metric, arg_max(method, {'v': v, 'm': method}) AS method, max(v) AS value FROM (SELECT method, round(avg(recall_10), 4) AS v FROM per GROUP BY method)"""))
def best_method(spark, d):
    scores, families = _scores(spark, d)
    return metrics.best_method(metrics.aggregate(scores, families, ["recall_10"]))


@query(sql.statement(*_RUN, sql.GOLD, sql.METRICS, select="""SELECT metric, method, value, abs(value - max(value) OVER (PARTITION BY metric)) < 1e-4 AS best FROM (UNPIVOT (
SELECT method, round(avg(recall_10), 4) AS recall_10, round(avg(ndcg), 4) AS ndcg FROM per GROUP BY method) ON recall_10, ndcg INTO NAME metric VALUE value)"""))
def report_table(spark, d):
    scores, families = _scores(spark, d)
    return export.table(metrics.aggregate(scores, families, ["recall_10", "ndcg"]))


@query(sql.statement(*_RUN, sql.GOLD, sql.FAMILIES, sql.METRICS, select="SELECT method, family, round(avg(recall_20), 6) AS coverage, round(avg(CASE WHEN recall_20 >= 1 THEN 1.0 ELSE 0 END), 6) AS complete, count(*) AS n FROM per JOIN fam USING (query_id) WHERE n_gold > 0 GROUP BY method, family"))
def family_metrics(spark, d):
    return metrics.family_metrics(*_scores(spark, d))


_DRAWS = """d AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS place, x - y AS d FROM (SELECT query_id, max(ndcg) FILTER (method = 'bm25') AS x, max(ndcg) FILTER (method = 'bm25_k12') AS y FROM per GROUP BY query_id) WHERE x IS NOT NULL AND y IS NOT NULL),
draws AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || place), 1, 8))::BIGINT % (SELECT count(*) FROM d) AS place FROM d, range(1, 1001) t(r)),
means AS (SELECT r, avg(d) AS m FROM draws JOIN d USING (place) GROUP BY r)"""


@query(sql.statement(*_RUN, sql.GOLD, sql.METRICS, _DRAWS, select="""SELECT (SELECT round(avg(d), 6) FROM d) AS mean_difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
round(least(1.0, 2 * least(avg((round(m, 12) <= 0)::INTEGER), avg((round(m, 12) >= 0)::INTEGER))), 6) AS p, 1000::BIGINT AS rounds FROM means"""))
def bootstrap_ci(spark, d):
    scores, _ = _scores(spark, d)
    return metrics.bootstrap(scores, "bm25", "bm25_k12", "ndcg")


@query(sql.statement(*_RUN, sql.GOLD, select="SELECT DISTINCT query_id, doc_id FROM runs WHERE doc_id IS NOT NULL AND (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM gold)"))
def pool_union(spark, d):
    runs = _runs(spark, d).where("doc_id is not null")
    return fusion.pool([runs.where(F.col("method") == m) for m in ("bm25", "bm25_k12")], _gold(spark, d))


@query(sql.statement(*_RUN, select="SELECT method, round(avg(CASE WHEN d.lang <> 'en' THEN 1.0 ELSE 0 END), 6) AS near_miss FROM runs JOIN documents d USING (doc_id) GROUP BY method"))
def near_miss(spark, d):
    """Documents in another language stand for hard negatives."""
    runs = _runs(spark, d)
    other = _t(spark, d, "documents").where("lang <> 'en'").select("doc_id")
    return metrics.near_miss(runs, runs.select("query_id", "doc_id").distinct().join(other, "doc_id", "left_semi"))


@query(sql.statement(sql.GOLD, select="SELECT query_id, doc_id FROM gold"))
def gold_verbatim(spark, d):
    return _gold(spark, d)


# ---- lexical ----


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS token_md5 FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)")
def tokenize(spark, d):
    t = _t(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_md5"))


@query("SELECT doc_id, length(text) // 4 AS token_estimate FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.token_estimate("text").cast("long").alias("token_estimate"))


@query(sql.statement(sql.CORPUS, select="SELECT term, df, round(idf, 6) AS idf FROM idf"))
def term_statistics(spark, d):
    terms, _ = lexical.term_statistics(lexical.tokenised(_chunks(spark, d)))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 10), select="SELECT query_id, doc_id, score, rank FROM best"))
def bm25_topk(spark, d):
    return lexical.bm25(_chunks(spark, d), _items(spark, d), 10).select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


_RARE = "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE regexp_extract(text, '[A-Za-z]{9,}') END AS text FROM benchmark"


@query(sql.statement(sql.CORPUS, sql.asked(_RARE), sql.scored(), f"padded AS (SELECT q.query_id, l.doc_id, coalesce(s.score, 0.0) AS score FROM ({_RARE}) q CROSS JOIN lens l LEFT JOIN scored s ON q.query_id = s.query_id AND l.doc_id = s.doc_id)", sql.top("best", "padded", 10), select="SELECT query_id, doc_id, score, rank FROM best"))
def bm25_zero_pad(spark, d):
    """Whole items, and for every other one a single rare word, whose lists are short."""
    rare = _items(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("text")).otherwise(F.regexp_extract("text", "[A-Za-z]{9,}", 0)).alias("text"))
    return lexical.bm25(_chunks(spark, d), rare, 10, padded=True).select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(k1=1.2), sql.top("best", "scored", 10), select="SELECT query_id, doc_id, score, rank FROM best"))
def bm25_published_k1(spark, d):
    return lexical.bm25(_chunks(spark, d), _items(spark, d), 10, k1=1.2).select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


_RM3 = [sql.CORPUS, sql.asked(), sql.scored(), sql.top("first", "scored", 10),
        "share AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM first WHERE score > 0)",
        "model AS (SELECT query_id, term, sum(share * tf / dl) AS p FROM share JOIN post USING (doc_id) JOIN lens USING (doc_id) GROUP BY ALL)",
        "chosen AS (SELECT query_id, term, p / sum(p) OVER (PARTITION BY query_id) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, term) AS n FROM model) WHERE n <= 10)",
        "mixed AS (SELECT query_id, term, sum(w) AS qtf FROM (SELECT query_id, term, 0.5 * qtf / sum(qtf) OVER (PARTITION BY query_id) AS w FROM asked UNION ALL SELECT query_id, term, 0.5 * p FROM chosen) GROUP BY ALL)",
        sql.scored("wide", terms="mixed"), sql.top("best", "wide", 10)]


@query(sql.statement(*_RM3, select="SELECT query_id, doc_id, score, rank FROM best"))
def rm3_topk(spark, d):
    index = lexical.build(_chunks(spark, d))
    return lexical.rm3(index, _items(spark, d), 10).select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 50), "placed AS (SELECT b.*, source FROM best b JOIN lens USING (doc_id))", sql.dedup("one", "placed", 10), select="SELECT query_id, source, doc_id, score, rank FROM one"))
def chunk_first_dedup(spark, d):
    ranked = lexical.bm25(_chunks(spark, d), _items(spark, d), 50).join(_chunks(spark, d).select("pos", "doc_id"), "pos")
    return fusion.first_per_document(ranked, 10).select("query_id", F.col("doc_id").alias("source"), F.col("pos").alias("doc_id"), "score", "rank")


def _two_lists(spark, d, k):
    names = _chunks(spark, d).select("pos", "doc_id")
    return [x.join(names, "pos") for x in lexical.ranked(_chunks(spark, d), _items(spark, d), k, (1.5, 1.2))]


@query(sql.statement(*_TWO, sql.top("top_a", "sc_a", 50), sql.top("top_b", "sc_b", 50), sql.fused("both_", ["top_a", "top_b"], "doc_id", 50), "placed AS (SELECT b.*, source FROM both_ b JOIN lens USING (doc_id))", sql.dedup("one", "placed", 10), select="SELECT query_id, source, doc_id, score, rank FROM one"))
def rrf_chunk(spark, d):
    return fusion.hybrid_chunks(_two_lists(spark, d, 50), _chunks(spark, d), 10).select("query_id", F.col("doc_id").alias("source"), F.col("pos").alias("doc_id"), "score", "rank")


@query(sql.statement(*_TWO, *(x for m in "ab" for x in (sql.top(f"top_{m}", f"sc_{m}", 90), f"placed_{m} AS (SELECT b.*, source FROM top_{m} b JOIN lens USING (doc_id))", sql.dedup(f"one_{m}", f"placed_{m}", 30))), sql.fused("both_", ["one_a", "one_b"], "source", 10), select="SELECT query_id, source, score, rank FROM both_"))
def rrf_doc(spark, d):
    return fusion.hybrid_documents(_two_lists(spark, d, 90), 10).select("query_id", F.col("doc_id").alias("source"), "score", "rank")


_SEEDS = "SELECT doc_id AS query_id, substr(text, 1, 500) AS text FROM documents WHERE doc_id % 50 = 0 AND length(text) > 100"


@query(sql.statement(sql.CORPUS, f"seeds AS ({_SEEDS})", sql.asked("SELECT * FROM seeds"), sql.scored(), sql.top("best", "scored", 120), "kept AS (SELECT b.query_id, b.doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM best b JOIN documents d ON b.doc_id = d.doc_id WHERE b.doc_id <> b.query_id AND length(d.text) > 100)", select="SELECT query_id, doc_id, score, rank FROM kept WHERE rank <= 40"))
def self_retrieval_cluster(spark, d):
    """The queries are the documents whose id is divisible by 50, against all."""
    seeds = _chunks(spark, d).where((F.col("pos") % 50 == 0) & (F.length("text") > 100))
    return lexical.topic_clusters(_chunks(spark, d), seeds).select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e') ORDER BY doc_id LIMIT 20")
def grep_scan(spark, d):
    return lexical.grep(_t(spark, d, "documents"), "licen[cs]e", 20, "doc_id").select("doc_id", "score")


# ---- dense ----


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS pos, round(list_inner_product(a.e, b.e), 6) AS score FROM u a, u b)
SELECT query_id, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, d):
    e = _t(spark, d, "embeddings")
    return dense.search(e.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


# ---- filters, reading, confidence ----

_ORDERS = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE year(o_orderdate) END AS year, o_orderpriority AS title, o_orderstatus AS abstract, [o_orderpriority, o_orderstatus] AS mesh_terms FROM orders"


def _orders(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("year"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract"), F.array("o_orderpriority", "o_orderstatus").alias("mesh_terms"))


@query(f"SELECT doc_id FROM ({_ORDERS}) WHERE coalesce(year, 0) >= 1994 AND coalesce(year, 9999) <= 1997")
def filter_meta_null(spark, d):
    o = _orders(spark, d)
    return filters.by_metadata(o.select("doc_id"), o, year_min=1994, year_max=1997)


@query(f"SELECT doc_id FROM ({_ORDERS}) WHERE (contains(lower(abstract || ' ' || title), 'urg') OR contains(lower(abstract || ' ' || title), 'med')) AND list_has_any(list_transform(mesh_terms, lambda x: lower(x)), ['f', 'p'])")
def filter_any(spark, d):
    o = _orders(spark, d)
    return filters.by_metadata(o.select("doc_id"), o, organisms=["URG", "med"], mesh_terms=["F", "p"])


@query("""SELECT o_orderkey AS doc_id, coalesce(n, 0) AS n, coalesce(parts, '') AS parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS parts FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def read_document(spark, d):
    parts = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_returnflag") == "A", "abstract").otherwise("body").alias("section_type"), F.lit("").alias("section_heading"), F.col("l_partkey").cast("string").alias("text"))
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    out = filters.read_document(docs, parts)
    line = F.transform("chunks", lambda c: F.concat_ws(":", c["position"], c["text"]))
    return out.select("doc_id", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(line, ","), F.lit("")).alias("parts"))


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 10), f"got AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 5) AS s5, avg(score) FILTER (rank <= 5) AS m5, count(*) AS n FROM best GROUP BY query_id)", select=f"""SELECT q.query_id, CASE WHEN s1 IS NULL THEN 0 ELSE round(least(1.0, s1 / 20), 6) END AS confidence, coalesce(round(CASE WHEN s5 IS NULL THEN 0 ELSE s1 - s5 END, 6), 0) AS gap, coalesce(round(m5, 6), 0) AS mean_top5, coalesce(n, 0) AS n,
s1 IS NULL OR (least(1.0, s1 / 20) < 0.3 AND CASE WHEN s5 IS NULL THEN 0 ELSE s1 - s5 END < 2) AS abstain FROM ({sql.ITEMS}) q LEFT JOIN got ON q.query_id = got.query_id"""))
def confidence(spark, d):
    items = _items(spark, d)
    return filters.confidence(lexical.bm25(_chunks(spark, d), items, 10), items)


@query(sql.statement(sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 10), select="SELECT b.query_id, b.rank, b.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, coalesce(substr(d.text, 1, 300), '') AS text FROM best b LEFT JOIN documents d ON b.doc_id = d.doc_id LEFT JOIN labels l ON b.doc_id = l.doc_id"))
def hash_lookup(spark, d):
    best = bm25_topk(spark, d)
    docs = _t(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.lit(None).cast("int").alias("year"), "text")
    out = filters.hydrate(best, docs).join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("query_id", "rank", "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "text")


# ---- verification ----

_CONSTRAINTS = f"cons AS (SELECT query_id, unnest(list_slice(list_filter({sql.tokens('text')}, lambda w: length(w) >= 7), 1, 3)) AS value FROM ({sql.ITEMS}))"
_CHECKED = [sql.CORPUS, sql.asked(), sql.scored(), sql.top("best", "scored", 50), _CONSTRAINTS,
            "placed AS (SELECT b.query_id, b.doc_id AS pos, b.rank, d.source, lower(d.text) AS low, row_number() OVER (PARTITION BY b.query_id, d.source ORDER BY b.rank) AS n FROM best b JOIN documents d ON b.doc_id = d.doc_id)",
            "tested AS (SELECT p.query_id, p.source, p.pos, p.rank, count(*) FILTER (contains(low, value)) AS met, count(*) AS needed FROM placed p JOIN cons c ON p.query_id = c.query_id WHERE n = 1 GROUP BY ALL)",
            "kinds AS (SELECT *, CASE WHEN met = needed THEN 'supporting' ELSE 'hard_negative' END AS kind FROM tested WHERE met > 0)",
            "checked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS ordinal FROM kinds) WHERE ordinal <= 10)"]


def _checked(spark, d):
    items, chunks = _items(spark, d), _chunks(spark, d)
    ranked = lexical.bm25(chunks, items, 50)
    values = F.slice(F.filter(T.tokens("text"), lambda w: F.length(w) >= 7), 1, 3)
    return verify.check(ranked, chunks, items.select("query_id", F.explode(values).alias("value")))


@query(sql.statement(*_CHECKED, select="SELECT query_id, source, pos, rank, met, needed, kind, ordinal FROM checked"))
def verify_tasks(spark, d):
    return _checked(spark, d).select("query_id", F.col("doc_id").alias("source"), "pos", "rank", F.col("met").cast("long").alias("met"), F.col("needed").cast("long").alias("needed"), "kind", "ordinal")


@query(sql.statement(*_CHECKED, sql.GOLD, sql.FAMILIES, select="""SELECT query_id, family, s AS supporting, h AS negatives, CASE WHEN family = 'abstention' THEN CASE WHEN s = 0 THEN 'auto_verified' WHEN s <= 2 THEN 'needs_review' ELSE 'rejected' END WHEN s >= 1 THEN 'auto_verified' WHEN h >= 1 THEN 'needs_review' ELSE 'rejected' END AS status
FROM (SELECT f.query_id, family, count(*) FILTER (kind = 'supporting') AS s, count(*) FILTER (kind = 'hard_negative') AS h FROM fam f LEFT JOIN checked c ON f.query_id = c.query_id GROUP BY f.query_id, family)"""))
def task_verdicts(spark, d):
    return verify.verdicts(_families(spark, d, _gold(spark, d)), _checked(spark, d))


# ---- citations and motifs ----

_EDGES = "SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem"
_BOTH = {"references": f"SELECT src AS doc_id, dst AS neighbour FROM ({_EDGES})", "cited_by": f"SELECT dst AS doc_id, src AS neighbour FROM ({_EDGES})"}


def _expanded(parts: str) -> str:
    return f"SELECT doc_id, neighbour, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY neighbour) AS ordinal FROM ({parts})) WHERE ordinal <= 50"


def _edges(spark, d):
    return _t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _expand(spark, d, direction):
    e = _edges(spark, d)
    roots = e.select(F.col("src").alias("doc_id")).union(e.select("dst"))
    return graph.expand(roots, e, direction)


@query(_expanded(_BOTH["references"]))
def citation_refs(spark, d):
    return _expand(spark, d, "references")


@query(_expanded(_BOTH["cited_by"]))
def citation_citedby(spark, d):
    return _expand(spark, d, "cited_by")


@query(_expanded(" UNION ".join(_BOTH.values())))
def citation_both(spark, d):
    return _expand(spark, d, "both")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_orderkey <> l_partkey) SELECT a.s AS a, count(*) AS chains FROM e a JOIN e b ON a.t = b.s WHERE a.s <> b.t GROUP BY a.s""")
def citation_two_hops(spark, d):
    e = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.two_hops(e).groupBy("a").agg(F.count("*").alias("chains"))


@query("""WITH known AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey <> l_orderkey)
SELECT l_orderkey AS root, max(l_partkey) FILTER (n = 1) AS second, max(l_partkey) FILTER (n = 2) AS third FROM known WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1""")
def citation_star(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("dst"))
    refs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("work"))
    return graph.motif("citation_chain")(refs.join(parts, refs["work"] == parts["dst"], "left"))


@query("""SELECT nct_id, pmid, doc_id, ordinal FROM (SELECT l_orderkey AS nct_id, l_partkey::VARCHAR AS pmid, p_name AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, p_name) AS ordinal FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem) JOIN part ON l_partkey = p_partkey) WHERE ordinal <= 3""")
def trial_papers(spark, d):
    line = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("nct_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey")))).alias("x"))
    trials = line.select("nct_id", F.transform("x", lambda x: F.struct(x["l_partkey"].cast("string").alias("pmid"))).alias("references"))
    docs = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("pmid"), F.col("p_name").alias("doc_id"))
    return graph.trial_papers(trials, docs)


_PLACED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pl, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


@query(f"""WITH p AS ({_PLACED}), b AS (SELECT *, CASE WHEN pl < n // 3 THEN 'early' WHEN pl >= n - ceil(n / 3) THEN 'late' WHEN pl < 2 * n // 3 THEN 'middle' END AS bucket, md5('42:' || o_orderkey) AS dice FROM p WHERE n >= 3)
SELECT o_custkey, arg_min(o_orderkey, dice) FILTER (bucket = 'early') AS early, arg_min(o_orderkey, dice) FILTER (bucket = 'middle') AS middle, arg_min(o_orderkey, dice) FILTER (bucket = 'late') AS late FROM b GROUP BY o_custkey""")
def contradiction_motif(spark, d):
    return graph.contradictions(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"SELECT o_custkey, o_orderkey, pl // greatest(1, n // 3) AS ordinal FROM ({_PLACED}) WHERE n >= 3 AND pl % greatest(1, n // 3) = 0 AND pl // greatest(1, n // 3) < 3")
def temporal_motif(spark, d):
    return graph.eras(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, ordinal FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey), o_orderkey) AS ordinal, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 3 AND ordinal <= 4")
def quantitative_motif(spark, d):
    return graph.spread(_t(spark, d, "orders"), "o_custkey", "o_orderkey")


# ---- corpus building ----


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def cross_query_dedup(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return corpus.first_owner(docs, "key", ["source", "doc_id"]).select("doc_id", "source")


@query("SELECT max(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY md5(text)")
def last_wins(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    return corpus.last_wins(docs, ["key"], "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_only(spark, d):
    return corpus.new_only(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN 'excluded_type' WHEN o_totalprice < 50000 THEN 'no_abstract' ELSE 'kept' END AS verdict FROM orders) GROUP BY verdict""")
def record_filter(spark, d):
    abstract = F.when(F.col("o_totalprice") >= 50000, F.col("o_orderpriority"))
    v = corpus.verdict(F.array("o_orderpriority", "o_orderstatus"), abstract, ["5-LOW", "P"])
    return _t(spark, d, "orders").select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, coalesce(p.url, '') AS oa_url, CASE WHEN d.lang = 'fr' THEN coalesce(p.url, '') ELSE d.source END AS venue FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
def enrichment_merge(spark, d):
    left = _t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("venue"))
    right = _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("oa_url"), F.col("url").alias("venue"))
    return corpus.enrich(left, right, "doc_id", ["oa_url"], ["venue"]).select("doc_id", F.coalesce("oa_url", F.lit("")).alias("oa_url"), "venue")


@query("""SELECT o_orderkey::VARCHAR AS pmid, CASE WHEN p_partkey IS NULL AND o_orderkey % 2 = 1 THEN o_orderkey::VARCHAR WHEN o_orderkey % 2 = 0 THEN 'PMC' || o_orderkey ELSE o_orderkey::VARCHAR END AS doc_id, CASE WHEN o_orderkey % 2 = 0 AND p_name IS NOT NULL THEN p_name ELSE '' END AS title, o_orderkey % 2 = 0 AND p_name IS NOT NULL AS has_fulltext FROM orders LEFT JOIN part ON o_orderkey = p_partkey""")
def fulltext_merge(spark, d):
    meta = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("PMC"), "o_orderkey")).otherwise("").alias("pmcid"), F.lit("").alias("title"), F.lit("x").alias("abstract"))
    none = lambda c: F.array().cast(f"array<{c}>")
    parsed = _t(spark, d, "part").select(F.concat(F.lit("PMC"), "p_partkey").alias("pmcid"), F.col("p_name").alias("title"), F.lit("").alias("abstract"), none(schema.SECTION).alias("sections"), none(schema.FIGURE).alias("figure_captions"), none(schema.TABLE).alias("table_texts"))
    return corpus.merge_full_text(meta, parsed).select("pmid", "doc_id", "title", "has_fulltext")


_PACK = r"""list_reduce(list_transform(string_split(text, '. '), lambda s: {'done': []::VARCHAR[], 'open': s}), lambda a, x: CASE WHEN length(a.open) + length(x.open) + 2 > 4096 AND a.open <> '' THEN {'done': list_append(a.done, a.open), 'open': x.open || '. '} ELSE {'done': a.done, 'open': a.open || x.open || '. '} END, {'done': []::VARCHAR[], 'open': ''})"""


@query(rf"""WITH p AS (SELECT doc_id, text, CASE WHEN length(text) > 4096 THEN {_PACK} END AS r FROM documents),
q AS (SELECT doc_id, CASE WHEN length(text) < 50 THEN [] WHEN r IS NULL THEN [text] WHEN trim(r.open) <> '' THEN list_append(r.done, r.open) ELSE r.done END AS pieces, text, r IS NOT NULL AS cut FROM p),
a AS (SELECT doc_id, 0 AS position, 'abstract' AS section_type, substr(text, 1, 2048) AS text, length(substr(text, 1, 2048)) // 4 AS token_estimate FROM documents WHERE length(text) > 0),
n AS (SELECT q.doc_id, q.text, lang, len(pieces) + 1 AS place FROM q JOIN documents USING (doc_id)),
c AS (SELECT doc_id, place AS position, 'caption' AS section_type, substr(text, 1, 1024) AS text, length(substr(text, 1, 1024)) // 4 AS token_estimate FROM n WHERE length(text) > 30),
t AS (SELECT doc_id, place + (length(text) > 30)::INTEGER AS position, 'table' AS section_type, substr(lang || ' ' || text, 1, 2048) AS text, length(substr(lang || ' ' || text, 1, 2048)) // 4 AS token_estimate FROM n WHERE length(lang || ' ' || text) > 30),
b AS (SELECT doc_id, i AS position, 'body' AS section_type, CASE WHEN cut THEN regexp_replace(pieces[i], '^\s+|\s+$', '', 'g') ELSE pieces[i] END AS text, length(pieces[i]) // 4 AS token_estimate FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM q))
SELECT doc_id, position, section_type, md5(text) AS text_md5, token_estimate, doc_id || '_' || section_type || '_' || position AS chunk_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t)""")
def structural_chunks(spark, d):
    """Each text is its own abstract, one section, a caption and a table's body."""
    section = F.array(F.struct(F.lit("").alias("heading"), F.lit("body").alias("section_type"), F.lit("").alias("parent_heading"), F.col("text"), F.length("text").alias("char_count")))
    figure = F.array(F.struct(F.lit("f1").alias("figure_id"), F.lit(None).cast("string").alias("label"), F.col("text").alias("caption")))
    cells = F.array(F.struct(F.lit("t1").alias("table_id"), F.lit("Table 1").alias("label"), F.col("lang").alias("caption"), F.col("text").alias("body_text")))
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("abstract"), section.alias("sections"), figure.alias("figure_captions"), cells.alias("table_texts"))
    return corpus.chunks(docs).select("doc_id", F.col("position").cast("long").alias("position"), "section_type", F.md5("text").alias("text_md5"), F.col("token_estimate").cast("long").alias("token_estimate"), "chunk_id")


@query("""SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, (sum(n_chars) // count(*))::BIGINT AS mean_floor, sum(n_chars)::BIGINT AS total, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY lang""")
def length_statistics(spark, d):
    return corpus.length_statistics(_t(spark, d, "documents"), "n_chars", ["lang"])


@query("SELECT source AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 20")
def venue_histogram(spark, d):
    return corpus.histogram(_t(spark, d, "documents"), "source", 20)


@query("SELECT value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM (SELECT unnest([event_type, json_extract_string(props, '$.k')]) AS value FROM events) GROUP BY value ORDER BY n DESC, value LIMIT 50")
def exploded_counts(spark, d):
    e = _t(spark, d, "events").select(F.array("event_type", F.get_json_object("props", "$.k")).alias("items"))
    return corpus.exploded_histogram(e, "items", 50)


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents WHERE length(text) > 100")
def group_members(spark, d):
    return corpus.grouped(_t(spark, d, "documents"), "source", "text", "doc_id").select("source", "doc_id", "ordinal")


# ---- text ----


@query(r"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' +([.,;:!?])', '\1', 'g')) AS clean_md5 FROM documents")
def clean_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.clean("text")).alias("clean_md5"))


@query("SELECT doc_id, md5(source || ' ' || text) AS lexical_md5, md5(substr(source || ': ' || text, 1, 2000)) AS dense_md5 FROM documents")
def compose_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.lexical_text("source", "text")).alias("lexical_md5"), F.md5(T.dense_text("source", "text")).alias("dense_md5"))


_HEADS = ["Introduction", " background ", "Materials and Methods", "Material & method", "STATISTICAL METHODS", "Results", "Results and Discussion", "Findings", "Concluding remarks", "Study design", "Acknowledgements", ""]
_WHOLE = ["introduction", "introduction", "methods", "methods", "other", "results", "results_discussion", "results", "conclusion", "methods", "other", "other"]
_PART = ["introduction", "introduction", "methods", "methods", "methods", "results", "results", "results", "other", "other", "other", "other"]


@query(f"SELECT doc_id, ({_WHOLE})[doc_id % 12 + 1] AS whole, ({_PART})[doc_id % 12 + 1] AS part FROM documents UNION ALL SELECT -doc_id - 1, 'other', CASE WHEN regexp_matches(lower(h), 'introduction|background') THEN 'introduction' WHEN regexp_matches(lower(h), 'method|material|procedure') THEN 'methods' WHEN regexp_matches(lower(h), 'result|finding') THEN 'results' WHEN regexp_matches(lower(h), 'discussion|interpretation') THEN 'discussion' WHEN regexp_matches(lower(h), 'conclusion|summary') THEN 'conclusion' ELSE 'other' END FROM (SELECT doc_id, source || ' ' || text AS h FROM documents)")
def section_class(spark, d):
    """Known headings over all documents, and whole texts as headings."""
    docs = _t(spark, d, "documents")
    known = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 12 + 1).cast("int"))
    heads = docs.select("doc_id", known.alias("heading")).unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.concat_ws(" ", "source", "text").alias("heading")))
    return heads.select("doc_id", T.section_type("heading").alias("whole"), T.section_type_by_part("heading").alias("part"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def inverted_index_rebuild(spark, d):
    """Texts become word -> positions maps and come back."""
    maps = records.inverted_indexes(_t(spark, d, "documents"), "doc_id")
    return maps.select("doc_id", F.when(F.col("index").isNotNull(), F.md5(T.text_of_inverted_index("index"))).alias("text_md5"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extraction(spark, d):
    """An object inside prose, as models reply."""
    reply = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Done."))
    return _t(spark, d, "events").select("event_id", F.get_json_object(T.json_object(reply), "$.k").alias("k"))


@query(r"SELECT conv_id, turn, array_to_string(list_slice(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d+'), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND 25))), 1, 15), ',') AS chosen FROM conversations")
def numbered_choices(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(T.numbered_choices("text", 25), lambda x: x.cast("string")), ",").alias("chosen"))


# ---- parsing ----

_TIDY = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' +([.,;:!?])', '\1', 'g')"
_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _escaped(column: str = "text"):
    """Whole texts as XML character data."""
    out = F.col(column)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


@query(f"""SELECT doc_id, source || ' & é' AS title, CASE WHEN length(t) > 20 THEN 2 ELSE 1 END::BIGINT AS section_count, CASE WHEN length(t) > 20 THEN md5(t) END AS text_md5, length(t) > 20 AS has_methods, 'Methods' AS above, 'Nested paragraph of ' || lang || ' text, [formula].' AS nested, 1::BIGINT AS figure_count, 1::BIGINT AS table_count,
'Bars by ' || source || ' <b>.' AS caption, source || ' | ' || lang || ' | 1' AS cells, CASE WHEN length(t) > 20 THEN length(t) ELSE 0 END + 41 + length(lang) AS total_chars FROM (SELECT doc_id, source, lang, {_TIDY} AS t FROM documents)""".replace("41 + length(lang)", "length('Nested paragraph of  text, [formula].') + length(lang)"))
def article_xml(spark, d):
    """Whole texts, with entities, mixed content, nested sections, a figure and a table."""
    x = lambda s: F.lit(s)
    xml = F.concat(x("<article><front><article-title>"), "source", x(" &amp; &#233;</article-title></front><body><sec><title>Methods</title><p>"), _escaped(), x("</p><sec><title>More</title><p>Nested <italic>paragraph</italic> of <bold>"), "lang", x("</bold> text<xref>, </xref><inline-formula>x=1</inline-formula>.</p></sec></sec><fig id=\"f1\"><label>Figure 1</label><caption><p>Bars by "), "source", x(" &lt;b> .</p></caption></fig><table-wrap id=\"t1\"><label>Table 1</label><caption><p>A caption of a table</p></caption><table><tr><td>"), "source", x("</td><td>"), "lang", x("</td><td>1</td></tr></table></table-wrap></body></article>"))
    parsed = records.articles(_t(spark, d, "documents").select("doc_id", xml.alias("xml")), "doc_id")
    first, last = F.try_element_at("sections", F.lit(1)), F.element_at("sections", -1)
    return parsed.select(F.col("pmcid").alias("doc_id"), "title", "section_count", F.when(first["section_type"] == "methods", F.md5(first["text"])).alias("text_md5"), "has_methods", last["parent_heading"].alias("above"), last["text"].alias("nested"), "figure_count", "table_count", F.element_at("figure_captions", 1)["caption"].alias("caption"), F.element_at("table_texts", 1)["body_text"].alias("cells"), "total_chars")


@query(f"""SELECT doc_id::VARCHAR AS pmid, source || ' < é' AS title, md5('AIM: ' || {_STRIPPED} || ' Said plainly.') AS abstract_md5, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1990 + doc_id % 30 END AS year, lang || ',' || lang || '/' || source AS mesh, 'PMC' || doc_id AS pmcid, '10.1/' || doc_id AS doi, 'Ö' || lang || ', A|B' AS authors, 'Review' AS types, source AS keywords, 'J ' || lang AS venue FROM documents""")
def record_xml(spark, d):
    x = lambda s: F.lit(s)
    k = F.col("doc_id").cast("string")
    date = F.when(F.col("doc_id") % 3 == 0, x("<Season>Spring</Season>")).when(F.col("doc_id") % 3 == 1, F.concat(x("<Year>"), (1990 + F.col("doc_id") % 30).cast("string"), x("</Year>"))).otherwise(F.concat(x("<MedlineDate>"), (1990 + F.col("doc_id") % 30).cast("string"), x(" Jan</MedlineDate>")))
    xml = F.concat(
        x("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), k, x("</PMID><Article><ArticleTitle>"), "source", x(" &lt; &#xE9;</ArticleTitle><ELocationID EIdType=\"doi\">10.1/"), k, x('</ELocationID><Abstract><AbstractText Label="AIM">'), _escaped(), x("</AbstractText><AbstractText>Said <i>plainly</i>.</AbstractText></Abstract><AuthorList><Author><LastName>Ö"), "lang",
        x("</LastName><ForeName>A</ForeName></Author><Author><LastName>B</LastName></Author><Author><ForeName>C</ForeName></Author></AuthorList><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList><Journal><Title>J "), "lang", x("</Title><JournalIssue><PubDate>"), date,
        x("</PubDate></JournalIssue></Journal></Article><MeshHeadingList><MeshHeading><DescriptorName>"), "lang", x("</DescriptorName><QualifierName>"), "source", x("</QualifierName></MeshHeading></MeshHeadingList><KeywordList><Keyword>"), "source", x("</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"pmc\">PMC"), k, x("</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle/></PubmedArticleSet>"),
    )
    m = records.metadata(_t(spark, d, "documents").select(xml.alias("xml")))
    return m.select("pmid", "title", F.md5("abstract").alias("abstract_md5"), F.coalesce("year", F.lit(-1)).cast("long").alias("year"), F.array_join("mesh_terms", ",").alias("mesh"), "pmcid", "doi", F.array_join("authors", "|").alias("authors"), F.array_join("publication_types", ",").alias("types"), F.array_join("keywords", ",").alias("keywords"), "venue")


@query(r"""SELECT doc_id, length(t) >= 10 AS has_section, CASE WHEN length(t) >= 10 THEN md5(t) END AS text_md5, CASE WHEN length(t) >= 10 THEN length(text) ELSE 0 END AS total_chars FROM (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def passage_json(spark, d):
    infons = F.create_map(F.lit("section"), F.lit("Statistical methods"), F.lit("type"), F.lit("paragraph"))
    doc = F.struct(F.array(F.struct(F.array(F.struct(infons.alias("infons"), F.col("text").alias("text"))).alias("passages"))).alias("documents"))
    p = records.passages(_t(spark, d, "documents").select("doc_id", F.to_json(doc).alias("json")), "doc_id")
    first = F.try_element_at("sections", F.lit(1))
    return p.select(F.col("pmcid").alias("doc_id"), F.col("has_methods").alias("has_section"), F.md5(first["text"]).alias("text_md5"), F.col("total_chars").cast("long").alias("total_chars"))


@query("SELECT p_partkey AS id, 'W' || p_partkey AS openalex_id, p_name || ' ' || p_brand AS abstract, CASE WHEN p_size > 15 THEN p_type ELSE '' END AS concept, 'W' || (p_partkey + 1) AS ref FROM part")
def work_json(spark, d):
    raw = _t(spark, d, "part").select(
        F.col("p_partkey").alias("k"),
        F.to_json(F.struct(F.concat(F.lit("W"), "p_partkey").alias("id"), F.create_map(F.col("p_brand"), F.array(F.lit(1)), F.col("p_name"), F.array(F.lit(0))).alias("abstract_inverted_index"),
                           F.array(F.struct(F.col("p_type").alias("display_name"), (F.col("p_size") / 50.0).alias("score"))).alias("concepts"), F.array(F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey") + 1)).alias("referenced_works"))).alias("j"))
    w = records.works(raw.select(F.from_json("j", schema.RAW_WORK).alias("w")).select("w.*"))
    return w.select(F.substring("openalex_id", 2, 20).cast("long").alias("id"), "openalex_id", "abstract", F.coalesce(F.try_element_at("concepts", F.lit(1))["name"], F.lit("")).alias("concept"), F.element_at("referenced_work_ids", 1).alias("ref"))


@query("SELECT 'NCT' || o_orderkey AS nct_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS start_date, o_orderpriority AS intervention, o_custkey::VARCHAR AS ref FROM orders")
def trial_json(spark, d):
    o = _t(spark, d, "orders")
    j = F.to_json(F.struct(F.struct(
        F.struct(F.concat(F.lit("NCT"), "o_orderkey").alias("nctId")).alias("identificationModule"),
        F.struct(F.col("o_orderstatus").alias("overallStatus"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("pmid"))).alias("references")).alias("referencesModule")).alias("protocolSection")))
    t = records.trials(o.select(F.from_json(j, schema.STUDY).alias("s")).select("s.*"))
    return t.select("nct_id", "status", "start_date", F.element_at("interventions", 1)["name"].alias("intervention"), F.element_at("references", 1)["pmid"].alias("ref"))


# ---- sampling ----

_SPLIT = """sp AS (SELECT *, CASE WHEN n < 3 THEN 'test' WHEN pl <= greatest(1, round_even(0.4 * n, 0)) THEN 'train' WHEN pl <= greatest(1, round_even(0.4 * n, 0)) + greatest(1, round_even(0.2 * n, 0)) THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS pl, count(*) OVER (PARTITION BY lang, source) AS n FROM documents))"""


@query(sql.statement(_SPLIT, select="SELECT doc_id, split FROM sp"))
def stratified_split(spark, d):
    return sampling.stratified_split(_t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"]).select("doc_id", "split")


@query(sql.statement(_SPLIT, select="SELECT 'fixture' AS dataset_name, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM sp) AS task_families, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM sp"))
def split_manifest(spark, d):
    s = sampling.stratified_split(_t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"]).withColumnRenamed("lang", "task_family")
    m = sampling.manifest(s, "fixture", "1")
    return m.select("dataset_name", F.array_join("task_families", ",").alias("task_families"), *(F.coalesce(F.try_element_at("splits", F.lit(x)), F.lit(0)).alias(x) for x in ("train", "dev", "test")), "total")


_SHARES = "SELECT lang AS family, count(*) / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY lang) AS ord FROM documents GROUP BY lang"


@query(f"""WITH s AS ({_SHARES}), b AS (SELECT *, greatest(1, round_even(share * 50, 0))::BIGINT AS base FROM s) SELECT family, greatest(2, round_even(share * 50, 0))::BIGINT AS floor2, (base + (ord <= 50 - sum(base) OVER ())::BIGINT)::BIGINT AS exact, (50 // count(*) OVER ())::BIGINT AS equal FROM b""")
def quota(spark, d):
    from pyspark.sql.window import Window

    by = _t(spark, d, "documents").groupBy(F.col("lang").alias("family")).count()
    whole = Window.partitionBy(F.lit(0))
    s = by.select("family", (F.col("count") / F.sum("count").over(whole)).alias("share"), F.row_number().over(whole.orderBy("family")).alias("ord"))
    out = s.select("family")
    for rule in ("floor2", "exact", "equal"):
        out = out.join(sampling.quota(s, 50, rule).withColumnRenamed("n", rule), "family")
    return out


@query("""SELECT doc_id, full_ FROM (SELECT doc_id, length(text) > 1000 AS full_, row_number() OVER (PARTITION BY length(text) > 1000 ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= CASE WHEN full_ THEN 35 ELSE 15 END""")
def seed_sampling(spark, d):
    return sampling.seed_sample(_t(spark, d, "documents").select("doc_id", (F.length("text") > 1000).alias("full_")), 50, "full_")


@query("""WITH g AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS o FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS c, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT c AS cluster, source, doc_id FROM g JOIN r USING (source) WHERE o <= 2 UNION ALL SELECT CASE WHEN c = 1 THEN n ELSE c - 1 END, source, doc_id FROM g JOIN r USING (source) WHERE o = 1""")
def comparative_sample(spark, d):
    return sampling.comparative_sample(_t(spark, d, "documents"), "source").select(F.col("cluster").cast("long").alias("cluster"), "source", "doc_id")


# ---- abstention ----

_FEATS = [*_RUN, sql.GOLD, sql.FAMILIES, "here AS (SELECT * FROM runs WHERE doc_id IS NOT NULL)",
          "agree AS (SELECT query_id, max(c) AS agree, sum(c) AS methods FROM (SELECT query_id, doc_id, count(*) AS c FROM here WHERE rank = 1 GROUP BY ALL) GROUP BY query_id)",
          "size_ AS (SELECT query_id, count(*) FILTER (method = 'bm25') AS nb, count(DISTINCT doc_id) FILTER (rank <= 10) AS nu FROM here GROUP BY query_id)",
          "sets AS (SELECT query_id, method, list(doc_id) AS s FROM here WHERE rank <= 10 GROUP BY ALL)",
          "jac AS (SELECT a.query_id, round(avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 6) AS j FROM sets a JOIN sets b ON a.query_id = b.query_id AND a.method < b.method GROUP BY a.query_id)"]


def _features(spark, d):
    tasks = _families(spark, d, _gold(spark, d)).withColumn("n_constraints", F.least(F.lit(3), F.size(F.filter(T.tokens("text"), lambda w: F.length(w) >= 7))))
    return abstention.features(_runs(spark, d), tasks)


@query(sql.statement(*_FEATS, select=rf"""SELECT f.query_id, coalesce(j, 0)::DOUBLE AS avg_pool_overlap, coalesce(nb, 0)::DOUBLE AS bm25_n_retrieved, least(3, len(list_filter({sql.tokens('b.text')}, lambda w: length(w) >= 7)))::DOUBLE AS n_constraints, coalesce(agree, 0)::DOUBLE AS n_methods_agree_top1, coalesce(nu, 0)::DOUBLE AS n_unique_top10,
len(list_filter(regexp_split_to_array(b.text, '\s+'), lambda w: w <> ''))::DOUBLE AS query_length, coalesce(round(agree / methods, 6), 0)::DOUBLE AS top1_agreement_rate, (family = 'abstention')::BIGINT AS label
FROM fam f JOIN benchmark b ON f.query_id = b.item_id LEFT JOIN jac ON f.query_id = jac.query_id LEFT JOIN agree ON f.query_id = agree.query_id LEFT JOIN size_ ON f.query_id = size_.query_id"""))
def abstention_features(spark, d):
    return _features(spark, d)


@query()
def gbt_abstention(spark, d):
    return abstention.out_of_fold(_features(spark, d))


@query()
def gbt_importance(spark, d):
    return abstention.importances(_features(spark, d))


_LABELLED = "lab AS (SELECT toxic AS label, round((n_chars % 997) / 997.0, 4) AS score FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select(F.col("toxic").alias("label"), F.round((F.col("n_chars") % 997) / 997.0, 4).alias("score"))


@query(sql.statement(_LABELLED, "r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM lab)", select="SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auroc FROM r"))
def auroc(spark, d):
    return abstention.auroc(_labelled(spark, d))


@query(sql.statement(_LABELLED, "r AS (SELECT label, sum(label) OVER w AS tp, count(*) OVER w AS seen FROM lab WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", select="SELECT round(sum(label * tp / seen) / sum(label), 6) AS average_precision FROM r"))
def avg_precision(spark, d):
    return abstention.average_precision(_labelled(spark, d))


_CURVE = [_LABELLED, "grid AS (SELECT i / 100 AS t FROM range(101) r(i))", "curve AS (SELECT t AS threshold, round(count(*) FILTER (score < t) / count(*), 6) AS coverage, round(coalesce(sum(label) FILTER (score < t) / nullif(count(*) FILTER (score < t), 0), 0), 6) AS risk FROM grid, lab GROUP BY t)"]


@query(sql.statement(*_CURVE, select="SELECT * FROM curve"))
def risk_coverage(spark, d):
    return abstention.risk_coverage(_labelled(spark, d))


@query(sql.statement(*_CURVE, select="SELECT round(abs(sum(d)), 6) AS aurc FROM (SELECT (coverage - lag(coverage) OVER (ORDER BY threshold)) * (risk + lag(risk) OVER (ORDER BY threshold)) / 2 AS d FROM curve)"))
def aurc(spark, d):
    return abstention.aurc(abstention.risk_coverage(_labelled(spark, d)))


@query(sql.statement(_LABELLED, "p AS (SELECT (score >= 0.5)::INTEGER AS p, label FROM lab)", select="SELECT round(sum(p * label) / sum(p), 6) AS precision, round(sum(p * label) / sum(label), 6) AS recall, round(2 * sum(p * label) / (sum(p) + sum(label)), 6) AS f1 FROM p"))
def decision_quality(spark, d):
    return metrics.precision_recall(_labelled(spark, d), (F.col("score") >= 0.5).cast("int"), F.col("label"))


# ---- agent ----


@query("SELECT conv_id AS query_id, key AS doc_id, round, row_number() OVER (PARTITION BY conv_id ORDER BY round) AS seen FROM (SELECT conv_id, md5(text) AS key, min(turn) AS round FROM conversations GROUP BY ALL)")
def agent_union(spark, d):
    found = _t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.md5("text").alias("doc_id"), F.col("turn").alias("round"), F.lit(1).alias("rank"))
    return fusion.accumulated(found)


_SECOND = rf"SELECT item_id AS query_id, array_to_string(list_slice({sql.tokens('text')}, -5, -1), ' ') AS text FROM benchmark"
_SEARCHES = [sql.CORPUS, sql.asked(), sql.asked(_SECOND, "asked2"), sql.scored("sc_a"), sql.scored("sc_b", terms="asked2"), *(x for m in "ab" for x in (sql.top(f"top_{m}", f"sc_{m}", 45), f"placed_{m} AS (SELECT b.*, source FROM top_{m} b JOIN lens USING (doc_id))", sql.dedup(f"one_{m}", f"placed_{m}", 15)))]


def two_rounds(open_tasks: DataFrame, r: int) -> DataFrame:
    """Searches for the question, then for its end, then stops."""
    text = F.col("text") if r == 1 else F.array_join(F.slice(T.tokens("text"), F.greatest(F.size(T.tokens("text")) - 4, F.lit(1)), 5), " ")
    action = "search" if r == 1 else "refine" if r == 2 else "stop"
    return open_tasks.select("query_id", F.to_json(F.struct(F.lit(action).alias("action"), text.alias("query"))).alias("reply"))


@query(sql.statement(*_SEARCHES, "u AS (SELECT query_id, source, min(r) AS r FROM (SELECT query_id, source, 1000 + rank AS r FROM one_a UNION ALL SELECT query_id, source, 2000 + rank FROM one_b) GROUP BY ALL)", "l AS (SELECT query_id, string_agg(source, ',' ORDER BY r) FILTER (n <= 20) AS docs, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n FROM u) GROUP BY query_id)", select=f"SELECT q.query_id, coalesce(docs, '') AS docs, coalesce(total, 0) AS total FROM ({sql.ITEMS}) q LEFT JOIN l ON q.query_id = l.query_id"))
def agent_rounds(spark, d):
    items, chunks = _items(spark, d), _chunks(spark, d)
    search = agent.environment(lexical.build(chunks), chunks)
    docs = _t(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.min_by("text", "doc_id").alias("text"))
    runs, _ = agent.run(items, two_rounds, search, docs)
    return runs.select("query_id", F.array_join("retrieved_docs", ",").alias("docs"), F.col("total_docs_seen").alias("total"))


@query("SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, round(sum(1 / (60 + l_linenumber)), 9) AS score, min((l_suppkey % 4) * 1000 + l_linenumber) AS first FROM lineitem GROUP BY ALL)) WHERE rank <= 20")
def rollout_fusion(spark, d):
    runs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 4).alias("rollout"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    return agent.fused_rollouts(runs)


@query("SELECT conv_id AS task_id, max(turn)::BIGINT AS iterations, count(DISTINCT turn) FILTER (role <> 'assistant') AS searches, round(1 - count(DISTINCT md5(text)) / count(*), 6) AS duplicate_ratio FROM conversations GROUP BY conv_id")
def workflow_metrics(spark, d):
    t = _t(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("round"), F.when(F.col("role") == "assistant", "stop").otherwise("search").alias("action"), F.md5("text").alias("doc_id"))
    return metrics.workflow(t)


@query("""SELECT source AS task_id, count(*) AS n_docs, CASE WHEN source LIKE '%1' THEN 0 ELSE count(*) END AS n_gold, 'What of ' || md5('Write a question.' || chr(10) || chr(10) || string_agg('Paper ' || o || ': ' || lang || ' (n.d.)' || chr(10) || substr(text, 1, 800) || chr(10) || 'Terms: ' || lang, chr(10) || chr(10) ORDER BY o)) || '?' AS question
FROM (SELECT source, lang, text, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS o FROM documents) WHERE o <= 5 GROUP BY source""")
def task_generation(spark, d):
    """Clusters of five to prompts to tasks; the stand-in for the model answers with
    its prompt's MD5."""
    docs = _t(spark, d, "documents")
    members = sampling.group_sample(docs, ["source"], 5).select(F.col("source").alias("task_id"), "ordinal", "doc_id", F.col("lang").alias("title"), F.lit(None).cast("int").alias("year"), F.col("text").alias("abstract"), F.array("lang").alias("mesh_terms"))
    prompts = generate.cluster_prompts(members, "Write a question.")
    replies = generate.ask(prompts, lambda batch: [f'Sure: {{"question": "What of {hashlib.md5(p.encode()).hexdigest()}?"}}' for p in batch])
    clusters = prompts.select("task_id", F.when(F.col("task_id").endswith("1"), "abstention").otherwise("multihop").alias("task_family"), F.lit("hard").alias("difficulty"), "doc_ids")
    t = generate.tasks_from_replies(replies, clusters, "grounded")
    return t.select("task_id", F.col("cluster_size").cast("long").alias("n_docs"), F.size("supporting_doc_ids").cast("long").alias("n_gold"), "question")


from tessera.plans import connectors, evaluation, parsing  # noqa: E402, F401 - they add their queries
