"""Splits, quotas and samples.  Order comes from a seeded md5 of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import SEED, dice


def stratified_split(tasks: DataFrame, key: str, strata: list[str], train: float = 0.4, dev: float = 0.2, seed: int = SEED) -> DataFrame:
    """tasks with ``split``.  Strata of three or more give at least one row to
    train and to dev; smaller ones go to test whole."""
    w = Window.partitionBy(*strata)
    p = tasks.withColumn("__at", F.row_number().over(w.orderBy(dice(key, seed=seed), key))).withColumn("__n", F.count("*").over(w))
    n_train = F.when(F.col("__n") >= 3, F.greatest(F.lit(1), F.bround(train * F.col("__n")))).otherwise(0)
    n_dev = F.when(F.col("__n") >= 3, F.greatest(F.lit(1), F.bround(dev * F.col("__n")))).otherwise(0)
    split = F.when(F.col("__at") <= n_train, "train").when(F.col("__at") <= n_train + n_dev, "dev").otherwise("test")
    return p.withColumn("split", split).drop("__at", "__n")


def manifest(tasks: DataFrame, name: str, version: str) -> DataFrame:
    """(dataset_name, version, task_families, splits, total) in one row."""
    by = tasks.groupBy("split").agg(F.count("*").alias("n"), F.collect_set("task_family").alias("f"))
    return by.agg(F.lit(name).alias("dataset_name"), F.lit(version).alias("version"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("task_families"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("splits"), F.sum("n").alias("total"))


def quota(shares: DataFrame, total: int, rule: str = "floor2") -> DataFrame:
    """(family, n) from (family, share).

    'floor2': at least 2 and the rounded share each.  'exact': at least 1 each,
    then one more to the first families, by order, while the total isn't met.
    'equal': total // families.
    """
    rounded = F.bround(F.col("share") * total).cast("int")
    if rule == "floor2":
        return shares.select("family", F.greatest(F.lit(2), rounded).alias("n"))
    one = Window.partitionBy(F.lit(0))  # a handful of families
    if rule == "equal":
        return shares.select("family", F.floor(F.lit(total) / F.count("*").over(one)).cast("int").alias("n"))
    base = shares.withColumn("n", F.greatest(F.lit(1), rounded)).withColumn("short", total - F.sum("n").over(one)).withColumn("at", F.row_number().over(one.orderBy("ord")))
    return base.select("family", (F.col("n") + (F.col("at") <= F.col("short")).cast("int")).alias("n"))


def quota_left(wanted: DataFrame, existing: DataFrame, key: str = "family") -> DataFrame:
    """(family, n): each family's quota less the rows it already has, at least 0."""
    have = existing.groupBy(key).agg(F.count("*").alias("__have"))
    return wanted.join(have, key, "left").select(key, F.greatest(F.lit(0), F.col("n") - F.coalesce("__have", F.lit(0))).cast("int").alias("n"))


def seed_sample(docs: DataFrame, n: int, full: str = "has_fulltext", share: float = 0.7, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """n documents, ``share`` of them with full text, the rest without."""
    m = int(n * share)
    order = [dice(key, seed=seed), F.col(key)]
    first = docs.where(full).orderBy(*order).limit(m)
    return first.unionByName(docs.where(~F.col(full)).orderBy(*order).limit(n - m))


def group_sample(docs: DataFrame, groups: list[str], n: int, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """n documents of each group."""
    order = Window.partitionBy(*groups).orderBy(dice(key, seed=seed), key)
    return docs.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= n)


def comparative_sample(docs: DataFrame, group: str, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(cluster, group, key): two documents of each group and one of the next.

    Groups are paired in seeded order, the last with the first.
    """
    drawn = group_sample(docs.select(group, key), [group], 2, key, seed)
    ring = docs.select(group).distinct()
    one = Window.partitionBy(F.lit(0)).orderBy(dice(group, seed=seed), group)  # group names only
    ring = ring.withColumn("cluster", F.row_number().over(one)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0)))).where("n >= 2")
    placed = drawn.join(ring, group)
    own = placed.select("cluster", group, key)
    lent = placed.where("ordinal = 1").select(F.when(F.col("cluster") == 1, F.col("n")).otherwise(F.col("cluster") - 1).alias("cluster"), group, key)
    return own.unionByName(lent)
