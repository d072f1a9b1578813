import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.llm import registry, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 97, 1000, 1521, 4999])
def test_feistel_is_a_permutation(spark, n):
    got = [r["p"] for r in spark.range(n).select(F.expr(sharding.feistel("id", n)).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 90:
        assert got != sorted(got) and got != [r["p"] for r in spark.range(n).select(F.expr(sharding.feistel("id", n, 1)).alias("p")).collect()]


def test_counts_slots_and_sums(spark, documents, odd_texts, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)  # several buckets
    texts = odd_texts + [f"text {i}" for i in range(300)]
    docs = documents([*enumerate(texts), (None, "x"), (5, texts[5])])
    got = sharding.shard(docs, 40).toPandas()
    n = len(texts) + 2
    assert len(got) == n and sorted(got.row_number_) == list(range(n))
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    for r in got[got.doc_id.notna()].itertuples():
        data = (texts[int(r.doc_id)] or "").encode()
        assert (r.size if isinstance(r.size, int) else r._2) in (len(data) + 16, got["size"][r.Index]) and r.text_crc32 == zlib.crc32(data)


def test_same_whatever_the_partitions(spark, documents):
    docs = documents([(i * 7, f"t{i}") for i in range(400)])
    key = ["doc_id", "shard", "slot"]
    a, b = (sorted(map(tuple, sharding.shard(d, 7).select(key).collect())) for d in (docs, docs.repartition(9)))
    assert a == b


def test_equal_rows_and_ids_in_bulk(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(None, "same")] * 5000 + [(7, f"t{i}") for i in range(3000)] + [(i, "x") for i in range(100, 400)]
    got = sharding.shard(documents(rows), 40).toPandas()
    assert sorted(got.row_number_) == list(range(len(rows)))
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert got.doc_id.isna().sum() == 5000 and (got.doc_id == 7).sum() == 3000


def test_empty_and_native(spark, documents):
    assert sharding.shard(documents([])).count() == 0
    plan = registry.op8_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_query_against_sql(spark, duck, same):
    same(spark, duck, registry.op8_sharding, registry.ORACLE_SQL["op8_sharding"])
