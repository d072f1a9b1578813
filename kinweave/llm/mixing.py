"""Mixing sources to target weights: Pfair windows and earliest deadline first, with DataFrame functions only.

Each source's rows are numbered (by the MD5 of id and text: a reproducible shuffle) and cut into blocks. Block j of a
source of share w may be released at slot floor(j / w) and is due at slot ceil((j + 1) / w); in each slot the released
block with the earliest deadline goes, which keeps every source within one block of its target in every prefix. Shares
are exact fractions of the weights as they are written (0.1 is a tenth), so the schedule repeats after the total of the
weights in whole numbers. If that cycle has ``LOOKUP`` slots or fewer it is worked out once, and the slot of any block
follows from (source, block number) by a lookup. A longer cycle is never completed: the schedule of the blocks that there
are is worked out by the driver, in chunks that go to a table, in memory that doesn't grow with the rows (about two
seconds for a million blocks); only the weights decide which way is taken.

All rows are kept. When a source runs out the others go on in proportion, within their windows. The driver holds the names,
weights and numbers of rows of the sources, however many there are. ``mix`` shuffles whole rows twice: to number those of a
bucket, and into the order of the slots, which are known only then.

Defined results: a null source is a source named ''; sources without a weight get ``default``; a weight of 0 or less
raises, since its rows could not be placed; repeated rows are placed as often as they occur; rows of one id (or none) with
different texts spread over the numbering, equal rows (id and text) stand together in it; an empty table gives an empty
result; ``mix`` carries every column through unchanged, whatever its name.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Rows of a numbering bucket, about; most bucket offsets that are broadcast; most slots of a cycle that is looked up (and
#: broadcast, 24 bytes each); blocks of a longer one that are written at a time; sources whose shares are broadcast.
BUCKET_ROWS, BROADCAST_BUCKETS, LOOKUP, CHUNK, BROADCAST_SOURCES = 2_000, 200_000, 100_000, 500_000, 100_000
#: No block has a number so large.
LONG = 2**62


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights in the smallest whole numbers of the same proportions."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def schedule(slots: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """Slot, source and number of each block in the order of the slots, the shares being slots / sum(slots): earliest
    deadline first among the released blocks of each source's first ``blocks``."""
    cycle = sum(slots.values())
    waiting = [(0, s, 0) for s in slots if blocks[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * cycle // slots[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield t, s, j
        t += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * cycle // slots[s], s, j + 1))


def _literal(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan."""
    names = [x.split()[0] for x in schema.split(",")]
    data = json.dumps([dict(zip(names, r)) for r in rows])
    return docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(data), "array<struct<" + schema.replace(" long", ":bigint").replace(" string", ":string") + ">>")))


def _plan(docs: DataFrame, slots: dict[str, int], blocks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """kw_source, kw_n, kw_cycle: blocks that a source has in a cycle, and the cycle's slots. kw_source, kw_turn, kw_at: the
    slot of each of these blocks."""
    cycle = sum(slots.values())
    names = sorted(slots)
    number = {s: i for i, s in enumerate(names)}
    if cycle <= LOOKUP:
        shares = [(slots[s], cycle, s) for s in names]
        turns = schedule(slots, slots)
    else:
        shares = [(LONG, 0, s) for s in names]
        turns = schedule(slots, blocks)
    of = _literal(docs, shares, "kw_n long, kw_cycle long, kw_source string")
    numbered = _literal(docs, list(enumerate(names)), "kw_i long, kw_source string")
    few = len(names) <= BROADCAST_SOURCES

    def lookup(part: list[tuple[int, str, int]]) -> DataFrame:
        text = ";".join(f"{t},{number[s]},{j}" for t, s, j in part)
        each = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("x")).select(F.split("x", ",").alias("x"))
        rows = each.select(F.col("x")[0].cast("long").alias("kw_at"), F.col("x")[1].cast("long").alias("kw_i"), F.col("x")[2].cast("long").alias("kw_turn"))
        return rows.join(F.broadcast(numbered) if few else numbered, "kw_i").select("kw_source", "kw_turn", "kw_at")

    if cycle <= LOOKUP:
        return F.broadcast(of) if few else of, F.broadcast(lookup(list(turns)))
    path = scratch.folder(docs.sparkSession)
    schema = "kw_source string, kw_turn long, kw_at long"
    part = list(islice(turns, CHUNK))
    while True:
        if part:
            lookup(part).write.mode("append").parquet(path)
        if not (part := list(islice(turns, CHUNK))):
            break
    return F.broadcast(of) if few else of, docs.sparkSession.read.schema(schema).parquet(path)


def placed(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text") -> DataFrame:
    """``docs`` with kw_source, kw_number (in its source), kw_block, kw_slot; the mix is the order by (kw_slot, kw_number)."""
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    ties = [F.md5(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary")))] if text_col else []
    key = F.concat_ws("-", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), *ties)
    ranked = docs.withColumn("kw_source", source).withColumn("kw_hash", F.md5(key))
    found = {r["s"]: r["count"] for r in docs.groupBy(source.alias("s")).count().collect()}
    slots = whole({s: (weights or {}).get(s, default) for s in found})
    if not found:
        return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], "kw_source", *(F.lit(None).cast("long").alias(x) for x in ("kw_number", "kw_block", "kw_slot")))
    shares, turns = _plan(docs, slots, {s: -(-n // block_rows) for s, n in found.items()})
    # Numbers in a source, in two passes: offsets of hash buckets, and ranks within a bucket.
    digits = 0
    while sum(found.values()) / 16**digits > BUCKET_ROWS:
        digits += 1
    ranked = ranked.withColumn("kw_bucket", F.substring("kw_hash", 1, digits))
    counts = ranked.groupBy("kw_source", "kw_bucket").agg(F.count(F.lit(1)).alias("kw_rows"))
    before = F.sum("kw_rows").over(Window.partitionBy("kw_source").orderBy("kw_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("kw_rows")
    offsets = counts.select("kw_source", "kw_bucket", before.alias("kw_before"))
    if 16**digits * len(found) <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    within = F.row_number().over(Window.partitionBy("kw_source", "kw_bucket").orderBy("kw_hash", f"`{id_col}`", *ties)) - 1
    numbered = ranked.withColumn("kw_within", within).join(offsets, ["kw_source", "kw_bucket"]).withColumn("kw_number", F.col("kw_before") + F.col("kw_within")).withColumn("kw_block", F.expr(f"kw_number div {block_rows}L"))
    timed = numbered.join(shares, "kw_source").withColumn("kw_turn", F.col("kw_block") % F.col("kw_n")).join(turns, ["kw_source", "kw_turn"])
    timed = timed.withColumn("kw_slot", F.expr("(kw_block div kw_n) * kw_cycle + kw_at"))
    return timed.select(*[F.col(f"`{c}`") for c in docs.columns], "kw_source", "kw_number", "kw_block", "kw_slot")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", **how) -> DataFrame:
    """``docs``, same columns and rows, stored in the order of the mix: range-partitioned and sorted by slot."""
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name clashes with a helper's
    timed = placed(docs.toDF(*place.values()), id_col=place[id_col], source_col=place[source_col], text_col=text_col and place[text_col], **how)
    return timed.repartitionByRange("kw_slot", "kw_number").sortWithinPartitions("kw_slot", "kw_number").select(*place.values()).toDF(*place)
