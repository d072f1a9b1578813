"""Line deduplication over whole tables, with DataFrame functions only.

Lines are hashed (128 bits) where they are read. The hashes are range-partitioned with the document and the position as
secondary sort, so the occurrences of a line stand together, in order, and one of a third of all documents still spreads
over several partitions. Streaming over them gives each line's first occurrence and its number of documents. What goes
back to the documents is a keep bitmap of each, compressed as runs of kept lines, never text or a list of positions.
Skew: the occurrences are joined with the frequent keys after these are stored, so that few of them are broadcast and
many go through an exchange whose hot parts the adaptive planner splits.

Defined results: a null or empty text is one empty line; a line whose key is shorter than ``min_chars`` always stays;
equal rows (same id, same text) are one document and get the same bitmap each; rows of one id with different texts are
different documents; a null id is an id like any other; an empty table gives an empty result; ``apply`` carries every
other column through unchanged, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: [\x20\x09-\x0D], which is stripped from both ends of a line for its key.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped, A-Z in lower case. ``lower`` is the fast way where the line is ASCII."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` clashes with."""
    taken = {c.lower() for c in df.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """id, text_hash, n_dropped, keep_runs (array of struct(start, length)) of the documents that lose any line; no text.

    A line goes if its key has ``min_chars`` code points or more and stands in ``min_docs`` documents or more: everywhere
    (``keep="none"``) or but for its first occurrence by id, text and position (``keep="first"``). The last run is open:
    its length is ``TO_THE_END``, whether or not lines follow.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep: 'first' or 'none', not {keep!r}")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.posexplode(lines(F.col(f"`{text_col}`"))).alias("pos", "line"))
    keyed = rows.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    # Written once: the range bounds are sampled from these thin rows, and no text is read or split again.
    hashed = scratch.table(keyed.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    # One row for each document that has the line. The range keys are the grouping keys: this needs no further exchange.
    ranged = hashed.repartitionByRange("h1", "h2", "id", "text_hash").sortWithinPartitions("h1", "h2", "id", "text_hash", "pos")
    found = ranged.groupBy("h1", "h2", "id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # Within a range a key's rows stream past in order; only one row of each key and range goes on.
    keys = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("id", "text_hash")).alias("first")).filter(F.col("n_docs") >= min_docs)
    # Written too: a join of stored keys is broadcast if they are few, and else has an exchange whose hot parts can be split.
    keys = scratch.table(keys)
    hit = found.join(keys.withColumnsRenamed({"h1": "k1", "h2": "k2"}), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    if keep == "first":
        is_first = F.col("id").eqNullSafe(F.col("first.id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
        hit = hit.withColumn("at", F.when(is_first, F.expr("slice(at, 2, size(at))")).otherwise(F.col("at")))
    gone = hit.groupBy("id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("gone")).filter(F.size("gone") > 0)
    return gone.select("id", "text_hash", F.size("gone").alias("n_dropped"), F.expr(_RUNS).alias("keep_runs"))


#: Length of the run behind the last dropped line: more lines than a text can have, and no overflow when it is added up.
TO_THE_END = 2**30
#: Runs of kept lines between the dropped positions ``gone``.
_RUNS = f"""filter(transform(sequence(0, size(gone)), i -> named_struct(
    'start', if(i = 0, 0, gone[i - 1] + 1),
    'length', if(i = size(gone), {TO_THE_END}, gone[i] - if(i = 0, 0, gone[i - 1] + 1)))), r -> r.length > 0)"""


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the text reduced to its kept lines, and two more columns: n_lines, n_dropped (named anew where taken)."""
    n_lines, n_dropped, runs, gone, d_id, d_hash = (_name(docs, x) for x in ("n_lines", "n_dropped", "kw_runs", "kw_gone", "kw_id", "kw_hash"))
    bitmaps = keep_bitmaps(docs, id_col, text_col, **how).toDF(d_id, d_hash, gone, runs)
    text = F.col(f"`{text_col}`")
    joined = docs.join(bitmaps, F.col(f"`{id_col}`").eqNullSafe(F.col(d_id)) & (F.xxhash64(text) == F.col(d_hash)), "left")
    split = lines(text)
    # Bound to a variable, so that the text is split once and not once for each run.
    bound = F.array(F.struct(split.alias("lines"), F.col(runs).alias("runs")))
    cut = F.transform(bound, lambda b: F.flatten(F.transform(b["runs"], lambda r: F.slice(b["lines"], r["start"] + 1, r["length"]))))
    kept = F.array_join(F.element_at(cut, 1), "\n")
    out = {text_col: F.when(F.col(runs).isNull(), F.coalesce(text, F.lit(""))).otherwise(kept), n_lines: F.size(split).cast("long"), n_dropped: F.coalesce(F.col(gone), F.lit(0)).cast("long")}
    names = [*docs.columns, n_lines, n_dropped]
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in names])
