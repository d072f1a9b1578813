"""From probabilities to matches: retention, conflict resolution and threshold sweeps, all as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

MARGIN, THRESHOLD = 0.05, 0.65


def retain(pairs: DataFrame, threshold: float, least: float = 0.20, slack: float = 0.15) -> DataFrame:
    """Pairs that may still matter at ``threshold``."""
    return pairs.filter(F.col("prob") >= F.greatest(F.lit(least), F.lit(threshold) - F.lit(slack)))


def with_counts(pairs: DataFrame) -> DataFrame:
    """n_pairs: how many pairs an entity has. Taken before or after ``retain``, it decides who gets the margin."""
    return pairs.withColumn("n_pairs", F.count(F.lit(1)).over(Window.partitionBy("s1_id")))


def assign(pairs: DataFrame, threshold: float | Column = THRESHOLD, margin: float = MARGIN, by: tuple[str, ...] = ()) -> DataFrame:
    """The matches: every target goes to the eligible entity of the highest probability, ties to the smaller id.

    Entities have no capacity, so the greedy claim in order of probability is each target's best pair. An entity's only
    pair needs ``margin`` more. ``pairs`` needs n_pairs (``with_counts``); ``by``: columns whose values are apart.
    """
    limit = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    eligible = pairs.filter(F.col("prob") >= F.when(F.col("n_pairs") == 1, F.round(limit + margin, 9)).otherwise(limit))
    best = F.row_number().over(Window.partitionBy(*by, "cand_id").orderBy(F.desc("prob"), "s1_id"))
    return eligible.withColumn("kw_place", best).filter(F.col("kw_place") == 1).drop("kw_place")


def matches_of_all(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """s1_id, matches (sorted): also those without any."""
    grouped = matches.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("matches"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(grouped, "s1_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))


def grid(first: float = 0.50, last: float = 0.90, step: float = 0.02) -> list[float]:
    return [round(first + i * step, 2) for i in range(round((last - first) / step) + 1)]


def sweep(pairs: DataFrame, truth: DataFrame, s1: DataFrame, thresholds: list[float] | None = None, by_country: bool = False) -> DataFrame:
    """threshold (and country), macro_f05, precision, recall: one row per threshold, from one pass over the pairs.

    The grid is a literal array in every row, exploded before the shuffle; thresholds then only partition windows apart.
    """
    thresholds = thresholds or grid()
    every = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    counted = with_counts(pairs)
    # A pair below the lowest threshold can match at none: it goes before the explode.
    tried = counted.filter(F.col("prob") >= min(thresholds)).select("*", every).filter(F.col("prob") >= F.col("threshold"))
    matches = assign(tried, F.col("threshold"), by=("threshold",))
    keys = ["country"] if by_country else []
    ids = s1.select(F.col("entity_id").alias("s1_id"), *keys, every)
    t = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select("s1_id", "cand_id", every)
    return metrics.macro(metrics.per_entity(ids, t, matches, ("threshold", "s1_id")), ("threshold", *keys))


def best_threshold(swept: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of the highest macro F0.5, the lowest one on ties; one row, or one for each value of ``by``."""
    best = F.max_by("threshold", F.struct(F.round("macro_f05", 9), -F.col("threshold"))).alias("threshold")
    return swept.groupBy(*by).agg(best, F.max("macro_f05").alias("macro_f05"))


def choose_thresholds(swept_by_country: DataFrame) -> DataFrame:
    """country, threshold: each country's best, or the best global one if that is at least as good over all.

    ``swept_by_country`` has n_entities, so that the global score is the weighted mean.
    """
    each = best_threshold(swept_by_country, ("country",))
    sizes = swept_by_country.select("country", "n_entities").distinct()
    score_each = each.join(sizes, "country").agg((F.sum(F.col("macro_f05") * F.col("n_entities")) / F.sum("n_entities")).alias("each_f05"))
    whole = swept_by_country.groupBy("threshold").agg((F.sum(F.col("macro_f05") * F.col("n_entities")) / F.sum("n_entities")).alias("macro_f05"))
    one = best_threshold(whole).select(F.col("threshold").alias("global_threshold"), F.col("macro_f05").alias("global_f05"))
    use_one = F.round("global_f05", 9) >= F.round("each_f05", 9)
    return each.join(F.broadcast(one)).join(F.broadcast(score_each)).select("country", F.when(use_one, F.col("global_threshold")).otherwise(F.col("threshold")).alias("threshold"), "global_threshold")
