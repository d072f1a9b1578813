"""Tables between the passes of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="kinweave-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, one process (master ``local``) uses a temporary
    folder of its machine, removed at its end; a cluster has no folder to share and raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/kinweave-{uuid.uuid4().hex}"


#: The folders of the tables that were made and not dropped, in order.
_made: list[str] = []


def table(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet and read back: cuts the lineage, and a lost executor costs no recomputation."""
    path = folder(df.sparkSession)
    _made.append(path)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if path in _made:
        _made.remove(path)


def drop(df: DataFrame) -> None:
    """Delete a table of ``table()`` that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def mark() -> int:
    """A place in the order of the tables, for ``drop_since``."""
    return len(_made)


def drop_since(spark: SparkSession, place: int, *keep: DataFrame) -> None:
    """Delete the tables that were made since ``mark`` gave the place, but for those to keep: what a finished step has left."""
    kept = {getattr(df, "scratch_path", None) for df in keep}
    for path in _made[place:]:
        if path not in kept:
            _delete(spark, path)
