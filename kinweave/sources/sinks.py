"""Sinks: candidate and match lists, shards and splits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def candidate_lists(s1: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per S1 record, its candidate ids in rank order, an empty list if there are none."""
    lists = ranked.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("r")).select("s1_id", F.array_join(F.col("r.cand_id"), ",").alias("ids"))
    return _all_s1(s1, lists, "candidate_entity_ids")


def match_lists(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per S1 record, its match ids sorted, an empty list if there are none."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))
    return _all_s1(s1, lists, "matched_entity_ids")


def _all_s1(s1: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    ids = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return ids.join(lists, ids["source1_entity_id"] == lists["s1_id"], "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias(name))


def backfill(written: DataFrame, s1: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """``written`` and an empty row for each S1 record that it lacks."""
    ids = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    missing = ids.join(written, "source1_entity_id", "left_anti").withColumn(name, F.lit(""))
    return written.select("source1_entity_id", name).unionByName(missing)


def write_tsv(lists: DataFrame, path: str, files: int | None = None) -> None:
    """Ordered by id; as many files as the data needs unless ``files`` says otherwise."""
    out = lists.orderBy("source1_entity_id")
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON text, such as metrics."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_shards(pairs: DataFrame, path: str) -> None:
    """Feature rows by country, zstd; a rerun overwrites the countries it writes and no others."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("country").parquet(path)


def write_split(split: DataFrame, path: str) -> None:
    """Entities with their split and metadata, one folder for each split."""
    split.write.mode("overwrite").partitionBy("split").parquet(path)
