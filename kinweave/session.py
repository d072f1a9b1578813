"""Sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the plans rely on. Posting caps above 1000 need the higher limit for their per-partition top rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "kinweave", **settings: str) -> SparkSession:
    """A session for this engine; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
