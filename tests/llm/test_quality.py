import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import quality, registry
from kinweave.llm.tables import read


def brute_marginals(odds, moves):
    """Sums over all labellings of one document."""
    n = len(odds)
    weight, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        w = np.exp(sum(odds[t] * y[t] for t in range(n)) + sum(moves[y[t], y[t + 1]] for t in range(n - 1)))
        weight += w
        good += w * np.array(y)
    return good / weight


@pytest.mark.parametrize("few", [0, 1, 3, 9])
@pytest.mark.parametrize("counts", [[1, 5, 3, 1, 7], [4], [1, 1], [9, 9, 2, 9]])
def test_marginals_against_enumeration(monkeypatch, few, counts):
    monkeypatch.setattr(quality, "FEW", few)
    rng = np.random.default_rng(1)
    counts = np.array(counts)
    odds, moves = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    got = quality.marginals(odds, counts, moves, True)
    at = 0
    for c in counts:
        assert np.allclose(got[0][at : at + c], brute_marginals(odds[at : at + c], moves))
        at += c
    assert np.isclose(got[1].sum(), (counts - 1).sum())


def test_features_see_neighbours():
    own, chars, counts = quality.line_features(["one two\nthree three three\n", "", "LOUD!! LOUD!!"])
    assert counts.tolist() == [3, 1, 1] and own.shape == (5, quality.OWN)
    before, after = quality.beside(own, counts)
    assert np.allclose(before[1], own[0]) and np.allclose(after[0], own[1])
    assert not before[3].any() and not after[3].any() and chars.tolist() == [7, 17, 0, 0, 13]
    rng = np.random.default_rng(0)
    k = 3 * quality.OWN
    field = quality.Field(rng.normal(size=k), rng.uniform(1, 2, k), rng.normal(size=k + 1), np.zeros((2, 2)), 1, 0)
    x = (np.hstack([own, before, after]) - field.mean) / field.scale
    assert np.allclose(quality.line_odds(own, counts, field), x @ field.weights[:-1] + field.weights[-1])


def test_very_long_texts(spark, documents):
    field = quality.train(quality.line_features(["fine words here", "LOUD!! LOUD!! LOUD!!"] * 20), [1, 0] * 20)
    texts = ["a line of words\n" * 200_000, "x" * 3_000_000, "\n" * 300_000, "word " * 400_000]
    tracemalloc.start()
    for t in texts:
        assert 0 <= quality.score_texts([t], field)[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 250_000_000
    tracemalloc.stop()
    got = quality.accepted(documents(enumerate(texts)), field)
    assert got.filter(F.col("doc_id") >= 4).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    assert quality.score(documents(enumerate(texts)), quality.fit(documents(enumerate(texts)), labels, train_lines=1000)).count() == 4


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    scored = registry.op4_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert len(bad) > 3 and (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id)


def test_only_texts_make_scores(spark, documents, odd_texts):
    field = quality.train(quality.line_features(["fine words here", "LOUD!! LOUD!! LOUD!!"] * 20), [1, 0] * 20)
    a = quality.score(documents(enumerate(odd_texts)), field)
    b = quality.score(documents([(i + 1000, t, "other") for i, t in enumerate(odd_texts)]).withColumn("lang", F.lit("xx")), field)
    assert sorted(round(r["score"], 9) for r in a.collect()) == sorted(round(r["score"], 9) for r in b.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in a.collect())
    assert quality.score(documents([]), field).count() == 0


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {1.0}
    bad = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, bad)).collect()} <= {0.0, 1.0}


def test_accepted_keeps_columns(spark, documents):
    field = quality.train(quality.line_features(["fine words here and there"] * 20 + ["LOUD!! LOUD!! LOUD!!"] * 20), [1] * 20 + [0] * 20)
    assert quality.accepted(documents([]), field).count() == 0
    assert quality.accepted(documents([(1, None), (None, ""), (None, "LOUD!! LOUD!! LOUD!!")]), field).count() in (0, 2)  # empty texts alike
    docs = documents([(1, "fine words here and there"), (2, "LOUD!! LOUD!! LOUD!!"), (1, "fine words here and there")]).withColumn("score", F.lit("mine"))
    got = quality.accepted(docs, field).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, "mine"), (1, "mine")]
