"""Sources of records and truth, always with an explicit schema, and entity views over other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "candidate_entity_ids")])


def scan_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated table with a header and no quoting; columns are checked against the header by name."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def scan_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of ``sinks.write_shards``."""
    return spark.read.parquet(path)


def scan_ids(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """entity_id: the distinct non-blank lines of a text file, or of its first ``most`` ones."""
    lines = spark.read.text(path).select(F.trim("value").alias("entity_id")).filter(F.col("entity_id") != "")
    return (lines if most is None else lines.limit(most)).distinct()


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """country, variant, canonical: mined rules as ``cli mine`` writes them."""
    return spark.read.schema("country string, variant string, canonical string").json(path)


def read_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """entity_id: the distinct ids of record tables; only that column is read."""
    return scan_tsv(spark, path).select("entity_id").filter(F.col("entity_id").isNotNull()).distinct()


def long_pairs(lists: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, cand_id), one row per listed id; raises if a column is missing."""
    missing = {id_col, list_col} - set(lists.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return lists.select(F.col(id_col).alias("s1_id"), F.explode(X.id_list(F.col(list_col))).alias("cand_id")).distinct()


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def split_sources(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference records (S1) and the union of the others."""
    return records.filter(F.col("entity_id").startswith("S1-")), records.filter(F.col("entity_id").startswith("S2-") | F.col("entity_id").startswith("S3-"))


def union_targets(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def union_dedupe(*sources: DataFrame) -> DataFrame:
    """One row of each id: that of the smallest name and address."""
    return union_targets(*sources).groupBy("entity_id").agg(F.min(F.struct("business_name", "business_address", "country")).alias("r")).select("entity_id", "r.*")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan, dealt to as many tasks as can run where its files have fewer splits: what follows costs far more
    than moving them. ``rows`` holds no shuffle, so asking for its partitions starts no job."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def _entity_id(key: str) -> Column:
    return F.concat(F.lit("S"), (1 + F.col(key) % 3).cast("string"), F.lit("-"), F.lpad(F.col(key).cast("string"), 7, "0"))


def entity_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of few names: heavy keys."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    address = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit(" Road, "), (10000 + F.col("p_partkey") % 50).cast("string"))
    country = F.when(F.col("p_size") % 3 == 0, "US").when(F.col("p_size") % 3 == 1, "India").otherwise("France")
    return spread(p.select(_entity_id("p_partkey").alias("entity_id"), F.col("p_name").alias("business_name"), address.alias("business_address"), country.alias("country")))


def entity_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of many names, with copies, accents and missing addresses. The view's definition (FIXTURES 3):
    a name is the first sentence, at most 60 characters of it, as business names are short. Only this view reads it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.substring(F.split_part(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("."), F.lit(1)), 1, 60)
    address = F.when(F.col("doc_id") % 29 == 0, None).otherwise(F.concat((F.col("n_chars") % 1000).cast("string"), F.lit(" "), F.col("source"), F.lit(" Street, "), (10000 + F.col("n_chars") % 500).cast("string")))
    return spread(d.select(_entity_id("doc_id").alias("entity_id"), name.alias("business_name"), address.alias("business_address"), F.col("lang").alias("country")))


def truth_part(records: DataFrame) -> DataFrame:
    """Pseudo truth of ``entity_part``: same name, country and postal code; the S1 record of the smallest id."""
    keyed = records.select("entity_id", "business_name", "country", X.postal_code(X.basic_clean(F.col("business_address"))).alias("postal"))
    return _same(keyed, ["business_name", "country", "postal"])


def truth_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo truth of ``entity_doc``: same whole text; the S1 record of the smallest id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _same(d.select(_entity_id("doc_id").alias("entity_id"), F.md5(F.col("text").cast("binary")).alias("text")), ["text"])


def _same(keyed: DataFrame, on: list[str]) -> DataFrame:
    """Each target that equals an S1 record goes to the one of the smallest id: a target belongs to one record at most, so
    there are no more pairs than targets, however many records are equal."""
    s1, targets = split_sources(keyed)
    return targets.withColumnRenamed("entity_id", "cand_id").join(s1.groupBy(*on).agg(F.min("entity_id").alias("s1_id")), on).select("s1_id", "cand_id")
