"""Linking a stream of new S1 records against a static target index, one micro-batch at a time.

The batch functions are the ones of the tables; the index is a stored posting table, so a batch costs its own keys only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking


def store_index(targets: DataFrame, path: str, cap: int = 300, policy: str = "truncate") -> None:
    """The posting lists of ``targets``, sorted by key within files, so that a batch's keys prune row groups."""
    blocking.postings(blocking.keys_v1(blocking.key_parts(targets)), {"key": cap}, policy).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def link_batch(batch: DataFrame, index_path: str, k: int = 35) -> DataFrame:
    """s1_id, cand_id, score, rank of a batch's records."""
    index = batch.sparkSession.read.parquet(index_path)
    return blocking.retrieve(blocking.keys_v1(blocking.key_parts(batch)), index, k).select("s1_id", "cand_id", "score", "rank")


def link_stream(records: DataFrame, index_path: str, out_path: str, checkpoint: str, k: int = 35, trigger: dict | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts a query that writes each batch's candidates under its own batch folder: a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        found = link_batch(batch, index_path, k)
        (then(found) if then else found).withColumn("linked_in", F.lit(number)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
