import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_fingerprint(text, words):
    w = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, most=2):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints(documents, odd_texts, spark):
    texts = odd_texts + ["one two three four", "ONE two\tthree\n four", "one two", "İ x É"]
    for words in (1, 3, 5):
        got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(documents(enumerate(texts)), words).collect()}
        assert got == {i: brute_fingerprint(t, words) for i, t in enumerate(texts)}


def test_spark_has_the_same_hash(spark):
    assert spark.sql("select xxhash64('one two three') as h").first()["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_the_distance_is_verified(spark):
    """Tables also give fingerprints that only agree in a segment; these are no links."""
    rng = random.Random(4)
    low = rng.getrandbits(32)
    fps = [signed(rng.getrandbits(32) << 32 | low ^ (1 << i % 3)) for i in range(12)] + [signed(7 << 32 | low), signed(7 << 32 | low ^ 6)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    entries = simhash.segment_table(df)
    assert entries.count() == 28 and {(r["segment"], r["value"]) for r in entries.filter(F.col("fp") == fps[-2]).collect()} == {(0, low), (1, 7)}
    got = {tuple(r) for r in simhash.table_links(entries, 2).collect()}
    assert got == {tuple(sorted((a, b))) for a in fps for b in fps if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert simhash.table_links(entries, 64).distinct().count() > 3 * len(got)


@pytest.mark.parametrize("crowded", [1, 3, 16])
@pytest.mark.parametrize("seed,most", [(0, 2), (1, 2), (2, 1)])
def test_components_against_all_pairs(spark, monkeypatch, seed, most, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [fps[0] & 0xFFFFFFFF | rng.getrandbits(32) << 32 for _ in range(30)]  # a hot segment value
    for _ in range(150):  # chains: each one or two bits from one before
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    ids = [signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    labels = {r["fp"]: r["label"] for r in simhash.components(simhash.links(df, most)).collect()}
    assert [labels.get(x, x) for x in ids] == brute_components(fps, ids, most)


def test_a_long_chain(spark):
    chain = [0]
    for b in range(40):
        chain.append(chain[-1] ^ (1 << b))
    df = spark.createDataFrame([(x,) for x in chain[::-2]], "fp long")
    assert {r["label"] for r in simhash.components(simhash.links(df)).collect()} == {0}


def test_whole_query(spark):
    from kinweave.llm import registry
    from kinweave.llm.tables import read

    rows = [(r["doc_id"], r["text"]) for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    want = {i: (f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op5_simhash(spark, "/root/testdata/sf0.001").collect()} == want


def test_one_of_each_group(documents):
    words = " ".join(f"w{i}" for i in range(300))
    docs = documents([(5, words), (3, words), (3, words), (9, words + "  "), (4, "something else entirely, of other words"), (7, ""), (8, None), (None, "only here")]).selectExpr("*", "1 as fp", "2 as label", "3 as kw_id", "4 as kw_first")
    got = simhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 3, 4, 7]
    assert simhash.near_duplicates(documents([])).count() == 0
