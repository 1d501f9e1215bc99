"""Citation links and the motifs sampled from them.

Links are a table (src, dst); every step is an equi-join on it.  The motifs
give one row for each root or group, chosen by a seeded hash where the
reference draws at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import store

SEED = 42


def dice(*columns: Column | str, seed: int = SEED) -> Column:
    """Seeded order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def work_id(url: Column | str) -> Column:
    """Last part of an id that may be written as a URL."""
    return F.element_at(F.split(url, "/"), -1)


def links(docs: DataFrame) -> DataFrame:
    """(src, dst) between documents, from their lists of referenced works."""
    refs = docs.select(F.col("doc_id").alias("src"), F.explode("referenced_work_ids").alias("ref")).select("src", work_id("ref").alias("work"))
    known = docs.where("openalex_id <> ''").select(work_id("openalex_id").alias("work"), "doc_id").groupBy("work").agg(F.min("doc_id").alias("dst"))
    return refs.join(known, "work").select("src", "dst").distinct()


def expand(roots: DataFrame, edges: DataFrame, direction: str = "both", most: int = 50) -> DataFrame:
    """(doc_id, neighbour, ordinal): at most ``most`` neighbours, by id."""
    parts = []
    if direction in ("references", "both"):
        parts.append(edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("neighbour")))
    if direction in ("cited_by", "both"):
        parts.append(edges.select(F.col("dst").alias("doc_id"), F.col("src").alias("neighbour")))
    if not parts:
        raise ValueError(f"unknown direction {direction!r}")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    roots = roots.select("doc_id")
    n = store.parts(every, roots)
    # moved before they are told apart, so that no task of the scan holds its part's keys
    near = every.repartition(n, "doc_id").join(roots.repartition(n, "doc_id").distinct(), "doc_id", "left_semi").distinct()
    return near.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("neighbour"))).where(F.col("ordinal") <= most)


def two_hops(edges: DataFrame) -> DataFrame:
    """(a, b, c): true chains, where the second document cites the third."""
    e = edges.where("src <> dst")
    second = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(second, "b").where("a <> c").select("a", "b", "c")


def citation_star(references: DataFrame, least: int = 3, papers: int = 3) -> DataFrame:
    """(root, second, third): a root and its first references in the corpus.

    references has (src, position, dst), dst null where the work is unknown.
    Roots list at least ``least`` works and have one known; third may be null.
    """
    size = references.groupBy("src").agg(F.count("*").alias("refs")).where(F.col("refs") >= least)
    known = references.where("dst is not null and dst <> src")
    placed = known.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("position", "dst"))).where(F.col("n") < papers)
    both = placed.groupBy("src").agg(F.max(F.when(F.col("n") == 1, F.col("dst"))).alias("second"), F.max(F.when(F.col("n") == 2, F.col("dst"))).alias("third"))
    return both.join(size, "src", "left_semi").select(F.col("src").alias("root"), "second", "third")


methods_chain = citation_star  # the same structure under another name


def trial_papers(trials: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """(nct_id, pmid, doc_id, ordinal): publications of trials in the corpus."""
    refs = trials.select("nct_id", F.posexplode("references").alias("place", "r")).select("nct_id", "place", F.col("r.pmid").alias("pmid")).where("pmid <> ''")
    found = refs.join(docs.select("pmid", "doc_id"), "pmid")
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("nct_id").orderBy("place", "doc_id"))).where(F.col("ordinal") <= most).select("nct_id", "pmid", "doc_id", "ordinal")


def _placed(dated: DataFrame, group: str, when: str, item: str) -> DataFrame:
    w = Window.partitionBy(group)
    return dated.select(group, item, when, (F.row_number().over(w.orderBy(when, item)) - 1).alias("at"), F.count("*").over(w).alias("n"))


def contradictions(members: DataFrame, group: str, when: str, item: str, seed: int = SEED) -> DataFrame:
    """(group, early, middle, late): one item of each third of a group.

    Groups of three or more with two or more dated ones.  The early third is
    rounded down, the late one up, so neither is what ntile would give.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("all"), F.count(when).alias("dated")).where("all >= 3 and dated >= 2")
    p = _placed(members.where(F.col(when).isNotNull()).join(sizes, group, "left_semi"), group, when, item)
    third, late = F.floor(F.col("n") / 3), F.col("n") - F.ceil(F.col("n") / 3)
    bucket = F.when(F.col("at") < third, "early").when(F.col("at") >= late, "late").when(F.col("at") < F.floor(2 * F.col("n") / 3), "middle")
    drawn = p.withColumn("bucket", bucket).where("bucket is not null")
    pick = drawn.groupBy(group).agg(*(F.min_by(item, F.when(F.col("bucket") == b, dice(item, seed=seed))).alias(b) for b in ("early", "middle", "late")))
    return pick.where("early is not null and late is not null")


def eras(members: DataFrame, group: str, when: str, item: str) -> DataFrame:
    """(group, item, ordinal): up to three items, evenly spaced in time."""
    p = _placed(members.where(F.col(when).isNotNull()), group, when, item).where("n >= 3")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return p.where((F.col("at") % step == 0) & (F.col("at") / step < 3)).select(group, item, (F.col("at") / step).cast("int").alias("ordinal"))


def spread(members: DataFrame, group: str, item: str, most: int = 4, least: int = 3, seed: int = SEED) -> DataFrame:
    """(group, item, ordinal): a seeded sample of each large enough group."""
    w = Window.partitionBy(group)
    p = members.select(group, item, F.row_number().over(w.orderBy(dice(item, seed=seed), item)).alias("ordinal"), F.count("*").over(w).alias("n"))
    return p.where((F.col("n") >= least) & (F.col("ordinal") <= most)).drop("n")


MOTIFS = {"trial_paper": trial_papers, "citation_chain": citation_star, "contradiction": contradictions, "quantitative_spread": spread, "temporal_arc": eras, "methods_chain": methods_chain}


def motif(name: str):
    """Sampler of that name, or None."""
    return MOTIFS.get(name)
