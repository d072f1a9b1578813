"""Concatenate-and-cut packing of documents into fixed windows of tokens.

Pass 1 tokenises every text once and writes, per document, its ids and its place within its *run* (one stored split of
the input, or one partition where the input is no file). Pass 2 adds the prefix sums of the run totals, which gives every
document a global token offset, and cuts at the multiples of the window. Nothing is shuffled but one row per run.

Defined results: a null or empty text holds the end id alone; repeated rows and repeated ids are packed as often as they
occur; a null id is carried along; an empty table gives no pieces; columns other than the two named are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Above so many runs their offsets are joined by a shuffle instead of being broadcast (24 bytes each).
BROADCAST_RUNS = 500_000


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to those of the ``tokenizers`` file.

    A byte-level BPE whose ids are 256 bytes followed by the merges in their order is run by tiktoken's merge loop, over
    ranks that are read out of that same file; it gives the same ids four times as fast. It refuses texts with very long
    runs of blanks (its pattern backtracks): these, and other files, are run by the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fast = self._ranks(json.load(open(path, encoding="utf-8")))

    @staticmethod
    def _ranks(spec: dict):
        import tiktoken

        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        plain = not spec.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            return None
        special = {t["content"]: t["id"] for t in added}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        vocab = model["vocab"]
        if [vocab[m] for m in merged] != list(range(256, 256 + len(merged))):
            return None
        # The byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        ids = None
        if self.fast:
            try:
                ids = self.fast.encode(text, allowed_special="all")
            except ValueError:  # "Max stack size exceeded for backtracking"
                pass
        if ids is None:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


def _stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the run that holds the row; runs sort as the rows are stored."""
    wanted = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    try:
        return docs.select(*wanted, F.col("_metadata.file_path").alias("run_file"), F.col("_metadata.file_block_start").alias("run_block"))
    except AnalysisException:
        return docs.select(*wanted, F.lit("").alias("run_file"), F.spark_partition_id().cast("long").alias("run_block"))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, run_file, run_block, run_start (ids before it in its run), n_tokens, ids (binary)."""
    rows = _stored(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("run_file", T.StringType()), T.StructField("run_block", T.LongType()), T.StructField("run_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        place: dict[tuple, int] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                starts, counts, ids = [], [], []
                for text, file, block in zip(batch["text"].to_pylist(), batch["run_file"].to_pylist(), batch["run_block"].to_pylist()):
                    x = encoder.encode(text or "") + end
                    starts.append(place.get((file, block), 0))
                    counts.append(len(x) // 4)
                    place[file, block] = starts[-1] + counts[-1]
                    ids.append(x)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["run_file"], batch["run_block"], pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    The documents follow one another in stored order, each closed by ``end_id``; sequence k holds the ids k*window up to
    (k+1)*window of that stream, so only the last one is short. A document cut at a boundary gives one piece a sequence.
    """
    docs_ids = scratch.table(tokenised(docs, tokenizer, end_id, id_col, text_col))
    totals = docs_ids.groupBy("run_file", "run_block").agg(F.sum("n_tokens").alias("run_tokens"))
    runs = totals.select("run_file", "run_block", (F.sum("run_tokens").over(Window.orderBy("run_file", "run_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("run_tokens")).alias("run_offset"))
    if totals.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    placed = docs_ids.join(runs, ["run_file", "run_block"]).withColumn("at", F.col("run_offset") + F.col("run_start"))
    w = window
    piece = f"""inline(transform(sequence(at div {w}L, (at + n_tokens - 1) div {w}L), s -> named_struct(
        'start', greatest(s * {w}L, at) - at,
        'length', least((s + 1) * {w}L, at + n_tokens) - greatest(s * {w}L, at),
        'ids', substring(ids, cast(4 * (greatest(s * {w}L, at) - at) + 1 as int), cast(4 * (least((s + 1) * {w}L, at + n_tokens) - greatest(s * {w}L, at)) as int)),
        'sequence_id', s,
        'offset', greatest(s * {w}L, at) - s * {w}L)))"""
    return placed.selectExpr("doc_id", "n_tokens as doc_tokens", piece)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), n_tokens, doc_ids: the pieces of each window joined in order; at most ``window`` ids a group."""
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids")).withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as long)"))
