import hashlib
import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import mixing, registry
from kinweave.llm.tables import read


def held_to(order, weights, blocks):
    """Less than one block from the target weights in every prefix, up to where a source runs out."""
    total = sum(Fraction(str(w)) for w in weights.values())
    share = {s: Fraction(str(w)) / total for s, w in weights.items()}
    seen = dict.fromkeys(weights, 0)
    for t, s, j in order:
        assert j == seen[s]
        for x in {s, min(weights)}:
            if seen[x] < blocks[x]:
                assert abs(seen[x] - t * share[x]) < 1
        seen[s] += 1
        assert abs(seen[s] - (t + 1) * share[s]) < 1
    return seen


@settings(max_examples=60, deadline=None)
@given(weights=st.dictionaries(st.text("abcdefgh", min_size=1, max_size=3), st.floats(0.01, 50), min_size=1, max_size=12))
def test_any_weights_are_held(weights):
    blocks = {s: 20 for s in weights}
    assert held_to(mixing.schedule(mixing.whole(weights), blocks), weights, blocks) == blocks


@pytest.mark.parametrize("weights", [{"src0": 4} | {f"src{i}": 1 for i in range(1, 8)}, {"a": 1, "b": 2}, {"a": 1e-6, "b": 1}, {"a": 0.1, "b": 0.7, "c": 0.2}, {"a": 0.123456789, "b": 3.3, "c": 1}])
def test_the_weights_are_held_over_many_slots(weights):
    slots, total = mixing.whole(weights), sum(weights.values())
    blocks = {s: int(w / total * 30_000) + 1 for s, w in weights.items()}
    order = list(mixing.schedule(slots, blocks))
    assert held_to(order, weights, blocks) == blocks and len(order) >= 29_990
    if sum(slots.values()) < 1000:  # the schedule of one cycle, repeated, is the same
        cycle = list(mixing.schedule(slots, slots))
        n = len(cycle)
        assert n == sum(slots.values())
        live = min(-(-blocks[s] * n // slots[s]) for s in slots) - n
        assert [(t, s) for t, s, _ in order if t < live] == [(t, cycle[t % n][1]) for t in range(live)]


def test_rows_are_all_placed_once(spark, documents):
    docs = documents([(i, f"t{i}", "big" if i % 3 else "small") for i in range(500)] + [(1, "t1", "big"), (None, None, None)])
    got = mixing.placed(docs, {"big": 3.0}, block_rows=4).toPandas()
    assert len(got) == 502
    for s, rows in got.groupby("kw_source"):
        assert sorted(rows.kw_number) == list(range(len(rows)))
        assert (rows.kw_block == rows.kw_number // 4).all()
    assert got.groupby("kw_slot").kw_source.nunique().max() == 1
    # While every source has rows, prefixes of slots hold the weights.
    blocks = got[["kw_source", "kw_block", "kw_slot"]].drop_duplicates()
    slots = {"big": 12, "small": 4, "": 4}
    first = {s: int((blocks.kw_source == s).sum()) for s in slots}
    last = min((blocks[blocks.kw_source == s].kw_slot.max() for s in ("big", "small")))
    for t in range(1, int(last)):
        for s in ("big", "small"):
            have = ((blocks.kw_source == s) & (blocks.kw_slot < t)).sum()
            assert abs(have - min(first[s], t * slots[s] / 20)) < 1


@pytest.mark.parametrize("weights", [{"src0": 4.0}, {"src0": 0.123456789012345, "src1": 3.3}])
def test_prefixes_hold_the_weights_themselves(spark, documents, monkeypatch, weights):
    monkeypatch.setattr(mixing, "CHUNK", 10_000)
    docs = documents([(i, f"t{i}", f"src{i % 20 if i < 36000 else 0}") for i in range(42000)])
    got = mixing.placed(docs, weights, block_rows=1).select("kw_source", "kw_slot").orderBy("kw_slot").toPandas()
    total = sum(weights.get(f"src{i}", 1.0) for i in range(20))
    for s, slots in got.groupby("kw_source").kw_slot:
        share = weights.get(s, 1.0) / total
        for j, t in enumerate(slots):  # j blocks before slot t, one more after it
            assert j - t * share > -1 - 1e-9 and j + 1 - (t + 1) * share < 1 + 1e-9
    assert got.kw_slot.is_unique


def test_order_is_stored_and_reproducible(spark, documents, tmp_path):
    docs = documents([(i, f"t{i}", f"s{i % 4}") for i in range(300)]).withColumn("kw_slot", F.lit(1))
    a, b = (mixing.mix(d, block_rows=4) for d in (docs, docs.repartition(7)))
    assert a.columns == docs.columns and a.collect() == b.collect()


def test_many_sources_and_bulky_ids(documents, monkeypatch):
    """No limit on sources; rows of one id or none are dealt over the numbering buckets."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 200)
    docs = documents([(i, "x", f"s{i}") for i in range(12_000)] + [(None, f"t{i}", "s1") for i in range(2000)] + [(1, "same", "s2")] * 500)
    got = mixing.placed(docs, block_rows=2).toPandas()
    assert len(got) == 14_500 and not got.duplicated(["kw_source", "kw_number"]).any()
    assert got.groupby("kw_slot").size().max() == 2
    bulk = got[got.doc_id.isna()]
    assert sorted(got[got.kw_source == "s1"].kw_number) == list(range(2001)) and len(bulk) == 2000


def test_weights_and_empty(documents):
    with pytest.raises(ValueError):
        mixing.whole({"a": 0.0})
    assert mixing.mix(documents([])).count() == 0


def brute_mix(rows, weights, block_rows):
    """doc_id, source, number, block, slot of each row: all blocks' windows, the earliest deadline of each slot searched for."""
    hashed = sorted((hashlib.md5(f"{i}-{h}".encode()).hexdigest(), i, s) for i, s, h in rows)
    by_source = {}
    for _, i, s in hashed:
        by_source.setdefault(s, []).append(i)
    total = sum(Fraction(weights.get(s, 1)) for s in by_source)
    share = {s: Fraction(weights.get(s, 1)) / total for s in by_source}
    done, slot, t = dict.fromkeys(by_source, 0), {}, 0
    while any(done[s] * block_rows < len(by_source[s]) for s in by_source):
        due = [(math.ceil((done[s] + 1) / share[s]), s) for s in by_source if math.floor(done[s] / share[s]) <= t]
        _, s = min(due)
        slot[s, done[s]] = t
        done[s] += 1
        t += 1
    return {(i, s, n, n // block_rows, slot[s, n // block_rows]) for s, ids in by_source.items() for n, i in enumerate(ids)}


def test_whole_query(spark):
    """Every row of the query against a plain search for the earliest deadline of each slot."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    want = brute_mix([tuple(r) for r in docs.collect()], registry.SOURCE_WEIGHTS, 16)
    got = {(r["doc_id"], r["source"], r["number"], r["block"], r["slot"]) for r in registry.op6_mixing(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(got) == docs.count()


def test_query_against_sql(spark, duck, same):
    same(spark, duck, registry.op6_mixing, registry.ORACLE_SQL["op6_mixing"])


def test_query_keeps_all_rows(spark):
    got = registry.op6_mixing(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 200 and not got.duplicated(["source", "number"]).any()
    plan = registry.op6_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
