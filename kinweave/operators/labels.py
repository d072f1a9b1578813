"""Training pairs: labels, forced positives, hardest negatives, class weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``pairs`` with label 1 for true pairs, else 0."""
    t = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(t, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def force_positives(ranked: DataFrame, truth: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, cand_id, rank): the retrieved pairs, then each entity's true pairs of the pool that were not retrieved."""
    reached = truth.select("s1_id", "cand_id").distinct().join(pool.select(F.col("entity_id").alias("cand_id")).distinct(), "cand_id", "left_semi")
    missed = reached.join(ranked, ["s1_id", "cand_id"], "left_anti")
    n = ranked.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("cand_id")) - 1
    added = missed.join(n, "s1_id", "left").withColumn("rank", (F.coalesce("n", F.lit(0)) + place).cast("int"))
    return ranked.select("s1_id", "cand_id", F.col("rank").cast("int")).unionByName(added.select("s1_id", "cand_id", "rank"))


def hard_negatives(labelled: DataFrame, n: int, by: str = "name_jw") -> DataFrame:
    """All positives and the ``n`` negatives of each entity that look most like matches."""
    place = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(F.desc(by), "cand_id"))
    return labelled.withColumn("place", place).filter((F.col("label") == 1) | (F.col("place") <= n)).drop("place")


def class_weight(labelled: DataFrame) -> DataFrame:
    """positives, negatives, scale_pos_weight = max(1, negatives / max(positives, 1)); a row counts ``times`` where it has them."""
    times = F.col("times") if "times" in labelled.columns else F.lit(1)
    counts = labelled.agg(*[F.coalesce(F.sum(F.when(F.col("label") == x, times)), F.lit(0)).alias(n) for x, n in ((1, "positives"), (0, "negatives"))])
    return counts.withColumn("scale_pos_weight", F.greatest(F.lit(1.0), F.col("negatives") / F.greatest("positives", F.lit(1))))
