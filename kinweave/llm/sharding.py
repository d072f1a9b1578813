"""A reproducible shuffle of all rows into shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers are ranks by the MD5 of (id, size, checksum): a function of the rows alone, not of files, partitions or
executors. The leading hex digits of the MD5 are the buckets of a two-pass numbering: rows are counted by bucket, the
counts are summed up, and the rank within the (evenly filled, bounded) bucket is added. Equal rows are folded into one
with a count by a partial aggregate and dealt out again behind the numbering, so that not even a third of all rows being
equal loads one task. The permutation is computed from
the row number and the number of rows, so the shard and slot of any row can be computed without the others.

Defined results: a null id ranks as the empty string, a null text has no bytes and checksum 0; equal rows are told apart
only by their numbers, which changes nothing in the result; rows of one id with different texts are different rows; an
empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a numbering bucket, about; and the most buckets whose offsets are broadcast (30 bytes each).
BUCKET_ROWS, BROADCAST_BUCKETS = 20_000, 70_000
#: Equal rows that are dealt out together.
PART = 1000
#: Steps of the cycle walk that are written into the plan; see ``feistel``.
WALK = 40


def feistel(number: str, n: int, seed: int = 0) -> str:
    """SQL for a permutation of 0..n-1 applied to the SQL ``number``.

    Four rounds over pairs (l, r) of Z_a x Z_b, a = ceil(sqrt n), b = ceil(n / a): each adds a hash of one half to the
    other, modulo its size. Fewer than a of the a*b pairs stand for n or more; from these the walk goes on along their
    cycle until it is below n. For n up to 1,600 WALK steps cover any cycle; above, each step fails with less than
    1 in sqrt(n), and should all of them fail the query stops with an error, never with a wrong number.
    """
    n = max(n, 1)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    mix = f"cast(conv(substr(md5(concat_ws('-', '{seed}', k, %s)), 1, 12), 16, 10) as bigint)"
    rounds = f"""aggregate(array(0, 1, 2, 3), named_struct('l', %s div {b}L, 'r', %s % {b}L), (p, k) -> if(k % 2 = 0,
        named_struct('l', (p.l + {mix % 'p.r'}) % {a}L, 'r', p.r), named_struct('l', p.l, 'r', (p.r + {mix % 'p.l'}) % {b}L)), p -> p.l * {b}L + p.r)"""
    permute = lambda x: rounds.replace("%s", x)
    return f"""aggregate(sequence(1, {WALK}), {permute(number)}, (x, i) -> if(x < {n}L, x, {permute('x')}),
        x -> if(x < {n}L, x, cast(raise_error('the cycle walk is too long') as bigint)))"""


def numbered(rows: DataFrame, n: int, keys: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """The columns ``keys`` of ``rows``, a row each, with row_number_ (long, 0..n-1, gapless); ``n`` is their number.

    Rows that are equal in ``keys`` are counted before anything is shuffled by them, numbered as one and dealt out again.
    """
    digits = 0
    while n / 16**digits > BUCKET_ROWS:
        digits += 1
    # Size and checksum join the id in the hash, so rows of one id (or of none) spread over the buckets.
    hashed = F.md5(F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    classes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("kw_rows")).withColumn("kw_hash", hashed).withColumn("kw_bucket", F.substring("kw_hash", 1, digits))
    counts = classes.groupBy("kw_bucket").agg(F.sum("kw_rows").alias("kw_all"))
    before = (F.sum("kw_all").over(Window.orderBy("kw_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("kw_all")).alias("kw_before")
    offsets = counts.select("kw_bucket", before)
    if 16**digits <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    order = Window.partitionBy("kw_bucket").orderBy("kw_hash", id_col, *keys)
    within = F.sum("kw_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("kw_rows")
    placed = classes.withColumn("kw_within", within).join(offsets, "kw_bucket").select(*keys, (F.col("kw_before") + F.col("kw_within")).alias("kw_first"), "kw_rows")
    # Equal rows are dealt out by the thousand, and these parts over all tasks.
    parts = placed.select(*keys, F.explode(F.expr(f"sequence(kw_first, kw_first + kw_rows - 1, {PART}L)")).alias("kw_first"), (F.col("kw_first") + F.col("kw_rows")).alias("kw_end"))
    return parts.repartition("kw_first").select(*keys, F.explode(F.expr(f"sequence(kw_first, least(kw_first + {PART}L, kw_end) - 1)")).alias("row_number_"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, row_number_, shuffled (its place in the permutation), shard, slot.

    shard = shuffled mod shards, slot = shuffled div shards: the counts of shards are at most one apart and slots are
    gapless from 0 in each.
    """
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = numbered(rows, n, ("doc_id", "size", "text_crc32")).withColumn("shuffled", F.expr(feistel("row_number_", n, seed)))
    return placed.withColumn("shard", (F.col("shuffled") % shards).cast("int")).withColumn("slot", F.expr(f"shuffled div {shards}L"))
