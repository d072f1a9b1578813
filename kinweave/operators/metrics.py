"""Scores of links: F0.5 per entity with credit for singletons, macro means, recall at K."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_entity(ids: DataFrame, truth: DataFrame, predicted: DataFrame, key: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """``ids`` with n_true, n_pred, tp, precision, recall, f05. Pairs of entities that are not in ``ids`` are ignored.

    Nothing true and nothing predicted is right (1, 1, 1); nothing true but something predicted has recall 1 and no more.
    """
    marks = truth.select(*key, "cand_id").distinct().withColumn("t", F.lit(1)).withColumn("p", F.lit(0)).unionByName(predicted.select(*key, "cand_id").distinct().withColumn("t", F.lit(0)).withColumn("p", F.lit(1)))
    each = marks.groupBy(*key, "cand_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = each.groupBy(*key).agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    zero = F.lit(0).cast("long")
    c = ids.join(counts, list(key), "left").withColumns({n: F.coalesce(n, zero) for n in ("n_true", "n_pred", "tp")})
    p, r = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    none = F.col("n_true") == 0
    pick = lambda empty, wrong, right: F.when(none & (F.col("n_pred") == 0), empty).when(none, wrong).when(F.col("tp") == 0, 0.0).otherwise(right)
    return c.withColumns({"precision": pick(1.0, 0.0, p), "recall": pick(1.0, 1.0, r), "f05": pick(1.0, 0.0, 1.25 * p * r / (0.25 * p + r))})


def macro(entities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over entities, counts, accuracy on singletons and F0.5 on the others; zeros for no entities."""
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    single = F.col("n_true") == 0
    return entities.groupBy(*by).agg(
        mean("f05", "macro_f05"), mean("precision", "macro_precision"), mean("recall", "macro_recall"), F.count(F.lit(1)).alias("n_entities"), F.count_if(single).alias("n_singletons"),
        mean(F.when(single, F.col("f05")), "singleton_accuracy"), mean(F.when(~single, F.col("f05")), "non_singleton_f05"),
    )


def recall_at(truth: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (30, 60, 100)) -> DataFrame:
    """k, hits, total, recall: true pairs among the first k candidates."""
    hit = truth.join(ranked.select("s1_id", "cand_id", "rank"), ["s1_id", "cand_id"], "left")
    sums = hit.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("rank") < k).alias(f"k{k}") for k in ks])
    return sums.select("total", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks]))).select("k", "hits", "total", (F.col("hits") / F.greatest("total", F.lit(1))).alias("recall"))


def candidates_per_entity(s1: DataFrame, ranked: DataFrame) -> DataFrame:
    """mean_candidates, zero_candidates over all S1 records."""
    n = ranked.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    all_n = s1.select(F.col("entity_id").alias("s1_id")).join(n, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return all_n.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_candidates"), F.count_if(F.col("n") == 0).alias("zero_candidates"))


def distribution(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of the values of ``by``."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select(*by, "n", (F.col("n") / F.col("total")).alias("share"))
