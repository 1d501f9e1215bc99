"""Corpus building: deduplication, filters, merges, chunks and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T


def last_wins(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """One row for each key, the one that came last.  One shuffle on the key."""
    order = Window.partitionBy(*key).orderBy(F.desc(ordinal))
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_owner(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Cross-query deduplication: the first row that brings a key keeps it."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def new_only(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not fetched before."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def verdict(types: Column, abstract: Column, excluded: list[str], need_abstract: bool = True) -> Column:
    """First rule that a record fails: 'excluded_type', 'no_abstract' or 'kept'."""
    listed = F.array(*[F.lit(x) for x in excluded]).cast("array<string>")
    out = F.when(F.coalesce(F.arrays_overlap(types, listed), F.lit(False)), "excluded_type")
    if need_abstract:
        out = out.when(F.coalesce(F.length(abstract), F.lit(0)) == 0, "no_abstract")
    return out.otherwise("kept")


def filter_records(df: DataFrame, excluded: list[str], need_abstract: bool = True) -> DataFrame:
    return df.where(verdict(F.col("publication_types"), F.col("abstract"), excluded, need_abstract) == "kept")


def enrich(left: DataFrame, right: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """Left merge: some columns of right replace, others fill empty ones.

    A record that right lacks stays as it was.  right has one row for a key.
    """
    columns = {c: f"__r_{c}" for c in [*overwrite, *fill]}
    there = right.select(F.col(key), F.lit(True).alias("__there"), *(F.col(c).alias(n) for c, n in columns.items()))
    both = left.join(there, key, "left")
    has = {c.lower() for c in left.columns}
    for c in overwrite:
        old = F.col(c) if c.lower() in has else F.lit(None)
        both = both.withColumn(c, F.when(F.col("__there"), F.col(columns[c])).otherwise(old))
    for c in fill:
        both = both.withColumn(c, F.coalesce(T.empty_to(c, columns[c]), F.col(c)))
    return both.drop("__there", *columns.values())


def merge_full_text(metadata: DataFrame, parsed: DataFrame) -> DataFrame:
    """Records with their parsed texts; ``doc_id`` is the pmcid, else the pmid."""
    nested = ["sections", "figure_captions", "table_texts"]
    right = parsed.select(F.col("pmcid").alias("__key"), F.lit(True).alias("__full"), F.col("title").alias("__title"), F.col("abstract").alias("__abstract"), *nested)
    out = metadata.join(right, metadata["pmcid"] == F.col("__key"), "left")
    out = out.withColumn("title", F.coalesce(T.empty_to("title", "__title"), "title")).withColumn("abstract", F.coalesce(T.empty_to("abstract", "__abstract"), "abstract"))
    return out.withColumn("doc_id", T.empty_to("pmcid", "pmid")).withColumn("has_fulltext", F.coalesce("__full", F.lit(False))).drop("__key", "__full", "__title", "__abstract")


def packed(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut after '. ' and filled greedily.

    Each sentence gets '. ' back, so a text that ends in '.' gains one; a
    sentence that is too long stays whole.  A fold over the sentences.
    """
    sentences = F.split(text, r"\. ", -1)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, sentence: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(sentence) + 2 > most) & (acc["open"] != "")
        done = F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, "").otherwise(acc["open"]), sentence, F.lit(". ")).alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(F.trim(acc["open"]) != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    return F.aggregate(sentences, empty, step, finish)


def _piece(kind: Column, heading: Column, text: Column, counted: Column) -> Column:
    return F.struct(kind.alias("section_type"), heading.alias("section_heading"), text.alias("text"), F.floor(F.length(counted) / 4).cast("int").alias("token_estimate"))


def chunks(docs: DataFrame, section_chars: int = 4096, abstract_chars: int = 2048, caption_chars: int = 1024, table_chars: int = 2048) -> DataFrame:
    """Structural chunks of merged documents; one row each, no shuffle.

    Abstract, then sections of 50 characters or more (long ones packed), then
    captions and tables of more than 30.  ``position`` counts a document's
    chunks from 0, and the chunk id holds it.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    head = F.substring("abstract", 1, abstract_chars)
    none = F.array().cast("array<struct<section_type: string, section_heading: string, text: string, token_estimate: int>>")
    abstract = F.when(F.length("abstract") > 0, F.array(_piece(F.lit("abstract"), F.lit("Abstract"), head, head))).otherwise(none)

    def section(s: Column) -> Column:
        kind, heading = F.coalesce(s["section_type"], F.lit("other")), F.coalesce(s["heading"], F.lit(""))
        whole = F.array(_piece(kind, heading, s["text"], s["text"]))
        return F.when(F.length(s["text"]) > section_chars, F.transform(packed(s["text"], section_chars), lambda p: _piece(kind, heading, strip(p), p))).otherwise(whole)

    body = F.flatten(F.transform(F.filter("sections", lambda s: F.length(s["text"]) >= 50), section))

    def capped(text: Column, most: int, kind: str, label: Column, missing: str) -> Column:
        return _piece(F.lit(kind), F.coalesce(label, F.lit(missing)), F.substring(text, 1, most), F.substring(text, 1, most))

    figures = F.transform(F.filter("figure_captions", lambda f: F.length(f["caption"]) > 30), lambda f: capped(f["caption"], caption_chars, "caption", f["label"], "Figure"))
    table = lambda t: F.concat_ws(" ", F.nullif(t["caption"], F.lit("")), F.nullif(t["body_text"], F.lit("")))
    tables = F.transform(F.filter("table_texts", lambda t: F.length(table(t)) > 30), lambda t: capped(table(t), table_chars, "table", t["label"], "Table"))
    every = F.concat(abstract, *(F.coalesce(x, none) for x in (body, figures, tables)))
    carried = [c for c in ("doc_id", "pmid", "pmcid", "year", "venue", "mesh_terms", "seed_query") if c in docs.columns]
    out = docs.select(*carried, F.posexplode(every).alias("position", "c")).select(*carried, "position", "c.*")
    return out.withColumn("chunk_id", F.concat_ws("_", "doc_id", "section_type", "position"))


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The element at place n // 2 of the sorted values, for each group.

    Equal values are counted first, so a group's window has one row a value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    ranked = counted.withColumn("__upto", F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__of", F.sum("__c").over(w))
    return ranked.where(F.col("__upto") > F.floor(F.col("__of") / 2)).groupBy(*by).agg(F.min("__v").alias("upper_median"))


def length_statistics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, least, most, floored mean, upper median and total of a length."""
    plain = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.floor(F.sum(value) / F.count("*")).alias("mean_floor"), F.sum(value).alias("total"))
    return plain.join(upper_median(df, value, by), by)


def histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n, percent), most frequent first, ties by value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("__all"))  # one row
    out = counted.crossJoin(total).select("value", "n", F.round(100 * F.col("n") / F.col("__all"), 1).alias("percent"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def exploded_histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    return histogram(df.select(F.explode(column).alias("__item")), "__item", top)


def grouped(df: DataFrame, group: str, text: str, order: str, least: int = 100) -> DataFrame:
    """Members of each group whose text is longer than ``least``, numbered."""
    kept = df.where(F.length(text) > least)
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(order)))
