"""Five stages over a corpus: quality, line dedup, near-duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept and returns documents; the last one returns the pieces of the
packed sequences. ``run`` writes what each stage returns as Parquet in the shared folder and gives the next one that table.

Mixing has no column to say its order in, so it says it in the order of the stored rows: the packing stage packs documents
in stored order. The quality stage fits a field and the near-duplicate stage compares fingerprints; SQL can't express them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import linededup, mixing, packing, quality, scratch, simhash
from kinweave.llm.registry import SOURCE_WEIGHTS, tokenizer_path
from kinweave.llm.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field accepts."""
    return quality.accepted(docs.select(*COLUMNS), quality.fit(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars counts anew."""
    kept = linededup.apply(docs.select(*COLUMNS), min_docs=10, min_chars=1, keep="none")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return simhash.without_near_duplicates(docs.select(*COLUMNS), words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order that holds the sources to their weights."""
    return mixing.mix(docs.select(*COLUMNS), weights=SOURCE_WEIGHTS, block_rows=16)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, over the documents in stored order."""
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("line_dedup", without_common_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages of quality and near-duplicates can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        place = scratch.mark()
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop_since(spark, place, docs)  # what the stage's operator has left
        scratch.drop(before)
    return docs
