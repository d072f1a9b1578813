"""Samples and splits that depend on ids and a seed only: ranks of a hash, never on partitions or order.

The hash is MD5, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str | Column, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(f":{seed}")))


def sample_n(rows: DataFrame, n: int, id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: a top-n, merged from each partition's own top-n."""
    return rows.orderBy(hash_order(id_col, seed), id_col).limit(n)


def entities_with_flag(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_id, country, num_matches, is_singleton."""
    n = truth.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("num_matches"))
    return s1.select("entity_id", "country").join(n, "entity_id", "left").withColumn("num_matches", F.coalesce("num_matches", F.lit(0).cast("long"))).withColumn("is_singleton", (F.col("num_matches") == 0).cast("int"))


def stratified_sample(entities: DataFrame, per_country: int, seed: int = 42) -> DataFrame:
    """Of each country five sixths matched entities and the rest singletons, as far as there are any."""
    matched = per_country * 5 // 6
    quota = F.when(F.col("is_singleton") == 0, matched).otherwise(per_country - matched)
    place = F.row_number().over(Window.partitionBy("country", "is_singleton").orderBy(hash_order("entity_id", seed), "entity_id"))
    return entities.withColumn("place", place).filter(F.col("place") <= quota).drop("place")


def stratified_split(entities: DataFrame, val_size: int, seed: int = 42, most: float = 0.2) -> DataFrame:
    """``split``: "val" for an equal share of each stratum (country x singleton), at most ``most`` of it; else "train"."""
    strata = entities.groupBy("country", "is_singleton").agg(F.count(F.lit(1)).alias("stratum"))
    total = strata.agg(F.sum("stratum").alias("total"))
    quotas = strata.join(F.broadcast(total)).select("country", "is_singleton", F.round(F.col("stratum") * F.least(F.lit(val_size) / F.col("total"), F.lit(most))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("country", "is_singleton").orderBy(hash_order("entity_id", seed), "entity_id"))
    return entities.withColumn("place", place).join(F.broadcast(quotas), ["country", "is_singleton"]).withColumn("split", F.when(F.col("place") <= F.col("quota"), "val").otherwise("train")).drop("place", "quota")


def fold(id_col: str | Column, folds: int, seed: int = 42) -> Column:
    """All rows of an id are in one fold; the folds are about equal."""
    return F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long") % folds


def grouped_holdout(rows: DataFrame, id_col: str = "s1_id", percent: int = 5, seed: int = 42) -> DataFrame:
    """held_out: true for about ``percent`` of the ids."""
    return rows.withColumn("held_out", fold(id_col, 100, seed) < percent)


def first_n(rows: DataFrame, n: int, id_col: str = "entity_id") -> DataFrame:
    """The first ``n`` rows in id order."""
    return rows.orderBy(id_col).limit(n)
