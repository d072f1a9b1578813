import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave.operators import assignment, blocking, features, labels, metrics, mining, models, sampling, validation, weights
from kinweave.operators.represent import represent, with_phonetics
from kinweave.plans import linkage
from kinweave.sources import records as R
from kinweave.sources import sinks


def recs(spark, rows):
    return spark.createDataFrame(rows, R.RECORD)


@pytest.fixture(scope="module")
def sides(spark):
    s1 = recs(spark, [("S1-001", "Maure Williams Colombier Inc", "85 Wayne Avenue, Ticonderoga, NY", "US"), ("S1-002", "No One Else", None, "US"), ("S1-003", "L'Oreal Produits De Beaute France SAS", "14 Rue Royale, 75008 Paris", "France")])
    targets = recs(spark, [("S2-001", "Maure Wilblims Colombier Inc", None, "US"), ("S2-002", "Something Completely Different", "123 Elm St", "US"), ("S3-001", "maurewilliamscolombier.com", "85 Wayne Ave, Ticonderoga", "USA"), ("S3-002", "L'Oreal Beaute France", "14 Rue Royale, 75008 Paris", "FR")])
    return s1, targets


def test_keys(spark, sides):
    keys = [r["key"] for r in blocking.keys_v1(blocking.key_parts(sides[0])).filter("entity_id = 'S1-001'").orderBy("key_ord").collect()]
    assert keys[0].startswith("nm_US_maure williams colombier") and keys[1].startswith("cp_US_maurewilliamscolombier") and keys[2].startswith("cr_US_maurewilliamscolombier")
    assert "tok_US_williams" in keys and "st_addr_US_85_wayne" in keys


@pytest.mark.parametrize("scripts", ["latin", "all"])
def test_retrieval(spark, sides, scripts):
    ranked = {(r["s1_id"], r["cand_id"]): r["rank"] for r in blocking.block_v1(*sides, 300, 35, "truncate", scripts).collect()}
    assert {("S1-001", "S3-001"), ("S1-001", "S2-001"), ("S1-003", "S3-002")} <= set(ranked)
    assert ("S1-001", "S2-002") not in ranked and ranked["S1-001", "S3-001"] == 0


def test_second_generation(spark, sides):
    over = blocking.block_v2(*sides, 10)
    got = {(r["s1_id"], r["cand_id"]): r for r in blocking.rerank(over, *sides, 5).collect()}
    assert {("S1-001", "S3-001"), ("S1-003", "S3-002")} <= set(got)
    r = got["S1-001", "S3-001"]
    assert r["final"] == pytest.approx(0.4 * min(1.4 * r["cosine"], 1) + 0.2 * r["fuzzy_addr"] + 0.4 * r["key_share"])


def test_tuning(spark):
    rows = [("a", "x", 0.7, 0.1, 0.0, 0.2), ("a", "y", 0.1, 0.9, 0.0, 0.1), ("b", "x", 0.3, 0.2, 0.5, 0.9), ("b", "z", 0.6, 0.1, 0.6, 0.1)]
    parts = spark.createDataFrame(rows, "s1_id string, cand_id string, cosine double, fuzzy_name double, fuzzy_addr double, key_share double")
    truth = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "q")], "s1_id string, cand_id string")
    got = {(r["w_cosine"], r["k"]): r["hits"] for r in blocking.tune_blend(parts, truth, [(1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)], (1, 2)).collect()}
    assert got == {(1.0, 1): 1, (1.0, 2): 2, (0.0, 1): 2, (0.0, 2): 2}
    assert len(blocking.blend_grid(0.5)) == 10 and all(abs(sum(w) - 1) < 1e-9 for w in blocking.blend_grid())


def hub(spark, n):
    s1 = recs(spark, [("S1-1", "hub", None, "US")])
    return s1, recs(spark, [(f"S2-{i:03d}", "hub", None, "US") for i in range(n)])


@pytest.mark.parametrize("n,policy,found", [(5, "drop", 5), (6, "drop", 0), (6, "truncate", 5)])
def test_caps(spark, n, policy, found):
    got = blocking.block_v1(*hub(spark, n), 5, 50, policy).orderBy("rank").collect()
    assert [r["cand_id"] for r in got] == [f"S2-{i:03d}" for i in range(found)]


def test_duplicate_keys_multiply(spark):
    s1 = recs(spark, [("S1-1", "lorem ipsum lorem", None, "US")])
    t = recs(spark, [("S2-1", "lorem dolor", None, "US"), ("S2-2", "dolor sit lorem lorem", None, "US")])
    got = {r["cand_id"]: r["score"] for r in blocking.block_v1(s1, t, 50, 50).collect()}
    assert got == {"S2-1": 2.0 + 2.0, "S2-2": 4.0}  # f1 and two query tokens; two by two tokens


def test_plans_never_cross(spark, sides):
    for plan in (blocking.block_v1(*sides, 300, 35, "truncate"), blocking.block_v1(*sides, 500, 40), blocking.block_v2(*sides, 10, phonetic=False)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "WindowGroupLimit" in blocking.block_v1(*sides, 300, 35, "truncate")._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_blocks_are_never_shuffled(spark, sides, tmp_path):
    """The pairs of a query are ranked where they arise: no exchange, window or aggregate stands above them."""
    plan = blocking.block_v2(*sides, 10)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert below and not any(x in above for x in ("Exchange", "Window", "Aggregate", "Join"))


def test_blocks_give_what_a_join_gives(spark, monkeypatch):
    """Equal queries, tokens that repeat, small blocks and small pieces; against pairs that are joined, added up and sorted."""
    from kinweave.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 3)
    monkeypatch.setattr(blocks, "PIECE", 2)
    name = lambda i: f"alpha{i % 3} beta{i % 4} beta{i % 4} gamma{i % 5}"
    s1 = recs(spark, [(f"S1-{i:02d}", name(i % 10), None if i % 7 == 0 else f"{i % 4} Oak Road, {10000 + i % 3}", "US" if i % 3 else "India") for i in range(30)])
    t = recs(spark, [(f"S2-{i:02d}", name(i + 1), None if i % 5 == 0 else f"{i % 6} Oak Oak Lane, {10000 + i % 4}", "US" if i % 2 else "India") for i in range(40)])
    caps, k = {"exact": 6, "key": 9}, 7
    q, u = blocking.key_parts(s1), blocking.key_parts(t)
    n = {r["country"]: r["count"] for r in u.groupBy("country").count().collect()}
    lists: dict = {}
    for r in sorted(blocking.keys_v2(u).collect(), key=lambda r: (r["entity_id"], r["key_ord"])):
        if len(lists.setdefault(r["key"], [])) < caps[r["cap_class"]]:
            lists[r["key"]].append(r["entity_id"])
    facts = {r["entity_id"]: r for x in (q, u) for r in x.collect()}
    scored: dict = {}
    for r in blocking.keys_v2(q).collect():
        for cand in lists.get(r["key"], []):
            x = scored.setdefault(r["entity_id"], {}).setdefault(cand, [0.0, 99, 0.0])
            w = r["weight"] * math.log1p(n[r["country"]] / len(lists[r["key"]]))
            x[0], x[1], x[2] = x[0] + w, min(x[1], r["key_ord"]), max(x[2], w)
    want = {}
    for i, found in scored.items():
        a, rows = facts[i], []
        for j, (score, first, _) in found.items():
            b = facts[j]
            boost = 2.0 * (a["postal"] is not None and a["postal"] == b["postal"]) + 1.5 * (a["street_no"] is not None and a["street_no"] == b["street_no"]) + 0.5 * min(2, sum(w in a["print_addr"] for w in b["print_addr"]))
            rows.append((-round(score + boost, 9), first, j, boost))
        best = max(x[2] for x in found.values())
        want |= {(i, j): (at, -score, boost, first, best) for at, (score, first, j, boost) in enumerate(sorted(rows)[:k])}
    got = {(r["s1_id"], r["cand_id"]): (r["rank"], r["score"], r["boost"], r["first_ord"], r["best_key"]) for r in blocking.block_v2(s1, t, k, caps).collect()}
    assert len(want) > 100 and set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x]) for x in want)


def crowd(spark):
    names = ["zulu alpha mills", "zulu beta mills", "yankee alpha works", "zulu zulu gamma"]
    rows = lambda who, n, step: recs(spark, [(f"{who}-{i:02d}", names[i * step % 4], None if i % 6 == 5 else f"{i % 5} Oak Road, {10000 + i % 3}", "US") for i in range(n)])
    return blocking.key_parts(rows("S1", 12, 1)), blocking.key_parts(rows("S2", 30, 3))


def _above(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")


def test_reranking_in_blocks(spark):
    """The same rows as ``rerank`` over all pairs, texts that can't reach the first ones left out; no pair is shuffled."""
    q, t = crowd(spark)
    mine = blocking.block_rerank(q, t, 4, 20)
    above, _, below = _above(mine)
    assert below and not any(x in above for x in ("Exchange", "Window", "Aggregate", "Join"))
    columns = sorted(mine.columns)
    got, want = ({(r["s1_id"], r["cand_id"]): [r[c] for c in columns if c not in ("s1_id", "cand_id")] for r in x.collect()} for x in (mine, blocking.rerank(blocking.block_v2(q, t, 20), q, t, 4)))
    assert len(want) == 48 and set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_cosines_in_blocks(spark):
    q, t = crowd(spark)
    mine = blocking.block_cosines(q, t, 20, phonetic=False)
    above, _, below = _above(mine)
    assert below and not any(x in above for x in ("Exchange", "Window", "Aggregate", "Join"))
    frequency = blocking.collection_frequency(t)
    all_pairs = blocking.cosines(blocking.block_v2(q, t, 20, phonetic=False), blocking.term_vectors(q, frequency), blocking.term_vectors(t, frequency))
    got, want = ({(r["s1_id"], r["cand_id"]): r["cosine"] for r in x.collect()} for x in (mine, all_pairs))
    assert len(want) > 100 and set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_boosted_pairs_are_not_shuffled(spark):
    from kinweave.plans import catalog

    above, _, below = _above(catalog.addr_boost(spark, "/root/testdata/sf0.001"))
    assert below and not any(x in above for x in ("Exchange", "Window", "Aggregate", "Join"))


def test_equal_records_are_one_row_of_their_number(spark, tmp_path):
    """Copies of S1 records add no rows to what is trained on, but each counts; held-out pairs and labels are those of all pairs."""
    from kinweave.plans import catalog

    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(20)
    p.crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("p_partkey", F.col("p_partkey") + 50 * F.col("k")).drop("k").write.parquet(str(tmp_path / "part.parquet"))
    inside, outside = catalog._split_rows(spark, str(tmp_path))
    s1, t = R.split_sources(catalog.part(spark, str(tmp_path)))
    pairs = labels.label(blocking.block_v1(s1, t, 300, 35, "truncate"), R.truth_part(catalog.part(spark, str(tmp_path))))
    want = {(r["s1_id"], r["cand_id"], r["label"], r["rank"]) for r in sampling.grouped_holdout(pairs, percent=30).filter("held_out").collect()}
    assert {(r["s1_id"], r["cand_id"], r["label"], int(r["cand_rank"])) for r in outside.collect()} == want and outside.count() == len(want)
    rows = sampling.grouped_holdout(pairs, percent=30).filter("not held_out")
    n, told = rows.count(), inside.agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("label")).alias("yes"), F.sum(F.col("times") * F.col("cand_rank")).alias("ranks")).first()
    assert (told["n"], told["yes"], told["ranks"]) == (n, rows.filter("label = 1").count(), rows.agg(F.sum("rank")).first()[0]) and inside.count() < n
    assert labels.class_weight(inside).first() == labels.class_weight(rows).first()


def test_features_in_blocks(spark):
    """The values of ``features`` over the pairs of ``block_v1``, made without a shuffle, join or second crossing to Python."""
    odd = [("Zoé Bäckerei & Söhne GmbH", "1 Rue de l'Été, 75008 Paris"), ("International Business Machines", "1 New Orchard Road, Armonk 10504"), ("IBM", "1 New Orchard Rd, Armonk 10504"), ("IBM Corp", None), ("", "5 Hill Road, 10504"), (None, "1 New Orchard Road"), ("Москва Щукин", "9 Улица, 10504"), ("aaa aaa", "aaa 5"), ("a b", "")]
    p = R.entity_part(spark, "/root/testdata/sf0.001").select("business_name", "business_address").limit(40).collect()
    both = [*odd, *map(tuple, p)]
    q = recs(spark, [(f"S1-{i:03d}", *x, "US") for i, x in enumerate(both)])
    t = recs(spark, [(f"S{2 + i % 2}-{i:03d}", *x, "US") for i, x in enumerate(both)])
    mine = blocking.featured_v1(q, t, 300, 12, "truncate", owners=spark.createDataFrame([("S2-000", "S1-000")], "entity_id string, owner string"))
    above, _, below = _above(mine)
    assert below and not any(x in above for x in ("Exchange", "Window", "Aggregate", "Join", "ArrowEvalPython"))
    got = {(i, r["cand_id"]): r for r in mine.collect() for i in r["ids"]}
    want = {(r["s1_id"], r["cand_id"]): r for r in features.features(blocking.block_v1(q, t, 300, 12, "truncate"), represent(q), represent(t)).collect()}
    assert len(want) > 300 and set(got) == set(want) and {r["owner"] for x, r in got.items() if x[1] == "S2-000"} == {"S1-000"}
    assert all(got[x][f] == want[x][f] for x in want for f in features.BASE_FEATURES)


def test_edits():
    from kinweave.functions import similarity as S

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = ["", "a", "ab", "ba", "kitten", "sitting", "aaaa", "aabaa", "été été", "москва 12", "x" * 70, "x" * 40 + "y" * 40]
    assert all(S.levenshtein(a, b) == plain(a, b) for a in words for b in words)


def test_features(spark):
    s1 = recs(spark, [("S1-1", "International Business Machines Corp", "1 New Orchard Road, Armonk, NY 10504", "US")])
    t = recs(spark, [("S2-1", "IBM Corporation", "1 New Orchard Rd, Armonk, New York 10504", "US"), ("S3-2", "Acme Bakery LLC", "99 Main St, Austin, TX", "US"), ("S2-3", None, None, None)])
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0, 1.0), ("S1-1", "S3-2", 1, 0.5), ("S1-1", "S2-3", 2, 0.0)], "s1_id string, cand_id string, rank int, score double")
    a, b = with_phonetics(represent(s1)), with_phonetics(represent(t))
    idf = weights.fit_idf(b, "name_tokens"), weights.fit_idf(b, "addr_tokens")
    made = features.features(pairs, a, b, idf)
    assert made.columns == ["s1_id", "cand_id", *features.ALL_FEATURES] and len(features.ALL_FEATURES) == 42 and len(features.BASE_FEATURES) == 33
    got = {r["cand_id"]: r for r in made.collect()}
    yes, no, empty = got["S2-1"], got["S3-2"], got["S2-3"]
    assert (yes["name_acronym_match"], yes["pin_match"], yes["st_num_match"], yes["cand_source_is_s2"]) == (1, 1, 1, 1)
    assert yes["name_jw"] > no["name_jw"] and yes["addr_jw"] > no["addr_jw"] and no["pin_match"] == 0 and no["st_num_match"] == -1
    assert (empty["addr_cand_missing"], empty["addr_both_present"], empty["addr_jw"], empty["name_bm25"]) == (1, 0, 0, 0)
    assert all(v is not None for r in got.values() for v in r)
    plan = features.features(pairs, represent(s1), represent(t))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_assignment(spark):
    pairs = spark.createDataFrame([("A", "S2-99", 0.90), ("A", "S3-01", 0.85), ("B", "S2-99", 0.75), ("B", "S3-02", 0.80), ("C", "S2-99", 0.60), ("D", "S2-50", 0.72), ("E", "S2-60", 0.75), ("F", "S2-70", 0.8), ("G", "S2-70", 0.8), ("F", "S2-71", 0.1), ("G", "S2-71", 0.1)], "s1_id string, cand_id string, prob double")
    got = {(r["s1_id"], r["cand_id"]) for r in assignment.assign(assignment.with_counts(pairs), 0.70).collect()}
    assert got == {("A", "S2-99"), ("A", "S3-01"), ("B", "S3-02"), ("E", "S2-60"), ("F", "S2-70")}
    assert assignment.retain(pairs, 0.8).count() == 8
    assert len(assignment.grid()) == 21 and len(assignment.grid(0.50, 0.94)) == 23


def test_f05(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = spark.createDataFrame([("a", "S2-00047"), ("a", "S3-00812"), ("c", "x"), ("d", "x")], "s1_id string, cand_id string")
    pred = spark.createDataFrame([("a", "S2-00047"), ("a", "S2-00193"), ("a", "S3-00812"), ("d", "y"), ("zz", "q")], "s1_id string, cand_id string")
    got = {r["s1_id"]: (round(r["precision"], 6), r["recall"], round(r["f05"], 6)) for r in metrics.per_entity(ids, truth, pred).collect()}
    assert got == {"a": (0.666667, 1.0, 0.714286), "b": (1.0, 1.0, 1.0), "c": (0.0, 0.0, 0.0), "d": (0.0, 0.0, 0.0)}
    m = metrics.macro(metrics.per_entity(ids, truth, pred)).first()
    assert m["macro_f05"] == pytest.approx((5 / 7 + 1) / 4) and m["n_singletons"] == 1
    assert metrics.macro(metrics.per_entity(ids.limit(0), truth, pred)).first()["macro_f05"] == 0.0
    wrong = metrics.per_entity(ids.filter("s1_id = 'b'"), truth, spark.createDataFrame([("b", "x")], pred.schema)).first()
    assert (wrong["precision"], wrong["recall"], wrong["f05"]) == (0.0, 1.0, 0.0)


def test_sampling(spark):
    e = spark.range(400).selectExpr("concat('S1-', id) as entity_id", "if(id % 2 = 0, 'US', 'IN') as country", "cast(id % 5 = 0 as int) as is_singleton", "1L as num_matches")
    split = sampling.stratified_split(e, 40)
    assert split.filter("split = 'val'").count() == 40
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, sampling.stratified_split(e.repartition(5), 40).collect()))
    assert sampling.stratified_sample(e, 12).groupBy("country", "is_singleton").count().agg(F.min("count"), F.max("count")).first()[:] == (2, 10)
    folds = e.select("entity_id", sampling.fold("entity_id", 3).alias("f")).groupBy("f").count().collect()
    assert len(folds) == 3 and min(r["count"] for r in folds) > 90
    assert sampling.sample_n(e, 7).count() == 7 and [r[0] for r in sampling.first_n(e, 2).select("entity_id").collect()] == ["S1-0", "S1-1"]


def test_labels(spark):
    ranked = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "x", 0)], "s1_id string, cand_id string, rank int")
    truth = spark.createDataFrame([("a", "y"), ("a", "z"), ("c", "z"), ("a", "gone")], "s1_id string, cand_id string")
    pool = spark.createDataFrame([("x",), ("y",), ("z",)], "entity_id string")
    got = {(r["s1_id"], r["cand_id"], r["rank"]) for r in labels.force_positives(ranked, truth, pool).collect()}
    assert got == {("a", "x", 0), ("a", "y", 1), ("a", "z", 2), ("b", "x", 0), ("c", "z", 0)}
    labelled = labels.label(ranked, truth)
    assert {r["cand_id"]: r["label"] for r in labelled.filter("s1_id = 'a'").collect()} == {"x": 0, "y": 1}
    assert labels.class_weight(labelled).first()[:] == (1, 2, 2.0)
    assert labels.hard_negatives(labelled.withColumn("name_jw", F.lit(0.5)), 1).count() == 3


def test_mining(spark):
    names = [("S1-1", "zunder traiding", "US"), ("S2-1", "zunder trading", "US"), ("S1-2", "oak traiding", "US"), ("S2-2", "oak trading", "US"), ("S2-3", "big trading", "US")]
    words = mining.mining_tokens(represent(recs(spark, [(i, n, None, c) for i, n, c in names])))
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-3")], "s1_id string, cand_id string")
    linked = mining.linked_words(truth, words)
    pairs = mining.variant_pairs(linked)
    assert [(r["x"], r["y"], r["n"]) for r in pairs.collect()] == [("trading", "traiding", 3)]
    rules = mining.canonical_map(pairs, mining.side_frequency(linked), least_n=2)
    assert [(r["variant"], r["canonical"]) for r in rules.collect()] == [("traiding", "trading")]
    reps = represent(recs(spark, [("S1-9", "traiding new traiding", None, "US"), ("S1-8", None, None, "US")]))
    assert {r["entity_id"]: r["name_tokens"] for r in mining.apply_map(reps, rules).collect()} == {"S1-9": ["trading", "new", "trading"], "S1-8": []}


def test_sinks_and_validation(spark, sides, tmp_path):
    s1, targets = sides
    ranked = blocking.block_v1(*sides, 300, 35)
    cands = sinks.candidate_lists(s1, ranked)
    matches = sinks.match_lists(s1, ranked.filter("rank = 0"))
    assert cands.count() == matches.count() == 3 and matches.filter("source1_entity_id = 'S1-002'").first()["matched_entity_ids"] == ""
    for name, df in (("candidate_pairs", cands), ("matching_results", matches)):
        sinks.write_tsv(df, str(tmp_path / f"{name}.tsv"))
    back = R.scan_tsv(spark, str(tmp_path / "matching_results.tsv"), R.TRUTH)
    assert back.count() == 3 and R.long_pairs(back).count() == ranked.filter("rank = 0").count()
    assert validation.header_problem(spark, str(tmp_path / "matching_results.tsv"), ("source1_entity_id", "matched_entity_ids")) is None
    assert validation.header_problem(spark, str(tmp_path / "gone"), ("a", "b")) == "missing"
    (tmp_path / "c").write_text("source1_entity_id,matched_entity_ids\n")
    (tmp_path / "w").write_text("a\tb\n")
    (tmp_path / "e").write_text("")
    assert [validation.header_problem(spark, str(tmp_path / x), ("source1_entity_id", "matched_entity_ids")) for x in "cwe"] == ["comma-separated", "wrong header", "empty"]
    assert validation.report(spark, back, "matched_entity_ids", s1, targets, cands) == []
    bad = spark.createDataFrame([("S1-001", "S2-001,S2-001"), ("S1-001", "S1-002"), ("S1-777", "S9-1,S2-001")], R.TRUTH)
    found = {f.rule: f.total for f in validation.report(spark, bad, "matched_entity_ids", s1, targets, cands)}
    assert found == {"duplicate row": 1, "repeated id": 1, "bad prefix": 2, "missing row": 2, "extra row": 1, "unknown id": 2, "match is no candidate": 2}
    assert validation.exit_code([validation.Finding("x", "warning", 3, [])]) == 0 and validation.exit_code([validation.Finding("x", "error", 1, [])]) == 1
    assert sinks.backfill(matches.filter("source1_entity_id <> 'S1-002'"), s1).count() == 3
    (tmp_path / "ids").write_text("a\n\n b \na\nc\n")
    assert sorted(r[0] for r in R.scan_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in R.scan_ids(spark, str(tmp_path / "ids"), 2).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        R.long_pairs(back.drop("matched_entity_ids"))
    lines = spark.createDataFrame([("a\tb",), ("ab",), (" ",)], "value string")
    assert validation.rows_without_tab(lines).count() == 1


def test_models_and_end_to_end(spark, tmp_path):
    rows = [(f"S1-{i:03d}", f"Alpha{i} Beta{i % 7} Works", f"{i} Oak Street, {10000 + i}", "US") for i in range(60)]
    s1 = recs(spark, rows)
    targets = recs(spark, [(f"S2-{i:03d}", f"Alpha{i} Beta{i % 7} Wrks Inc", f"{i} Oak St, {10000 + i}", "USA") for i in range(50)] + [(f"S3-{i:03d}", f"Gamma{i} Beta{i % 7}", f"{i + 500} Elm St", "US") for i in range(60)])
    truth = spark.createDataFrame([(f"S1-{i:03d}", f"S2-{i:03d}") for i in range(50)], "s1_id string, cand_id string")
    models.PRESETS["tiny"] = models.Preset(3, 3, 0.3, 3, 2, 4)
    how = linkage.Candidates(generation=1, scripts="latin", cap=100, k=10)
    matcher, result = linkage.train(s1, targets, truth, val_size=12, preset="tiny", how=how, enhanced=False)
    assert result["auc"] > 0.9 and result["macro_f05"] > 0.5 and len(result["importance"]) == 15
    matcher.save(str(tmp_path / "m"))
    again = models.Matcher.load(str(tmp_path / "m"))
    assert again.columns == matcher.columns and again.thresholds == matcher.thresholds
    cands, matches = linkage.predict(s1, targets, again, how)
    assert cands.count() == matches.count() == 60
    both = s1.union(recs(spark, [("S1-990", "Omega Bank", "1 Rue Royale, 75008", "France")]))
    more = truth.union(spark.createDataFrame([("S1-990", "S3-001")], truth.schema))
    report = linkage.harness(both, targets, more, how, again, per_country=600, ks=(1, 10), caps=(2, 10))
    assert set(report) == {"US", "FRANCE"} and report["US"]["n_entities"] == 60 and report["US"]["pool_size"] == 110 and report["US"]["total_true_links"] == 50
    assert report["US"]["blocking_recall"]["10"] == report["US"]["recall_of_all"] == 1.0 and "missed" not in report["US"] and report["US"]["end_to_end_cap10"]["macro_f05"] > 0.5
    assert report["FRANCE"]["blocking_recall"] == {"1": 0.0, "10": 0.0} and report["FRANCE"]["missed"] == {"other country": 1} and report["FRANCE"]["zero_candidates"] == 1


def test_pairs_to_shards_to_a_model(spark, tmp_path):
    s1 = recs(spark, [(f"S1-{i:03d}", f"Alpha{i} Beta{i % 7} Works", f"{i} Oak Street, {10000 + i}", "US" if i % 3 else "India") for i in range(60)])
    targets = recs(spark, [(f"S2-{i:03d}", f"Alpha{i} Beta{i % 7} Wrks Inc", f"{i} Oak St, {10000 + i}", "USA" if i % 3 else "IND") for i in range(60)])
    truth = spark.createDataFrame([(f"S1-{i:03d}", f"S2-{i:03d}") for i in range(50)], "s1_id string, cand_id string")
    how = linkage.Candidates(generation=2, k=8, overgenerate=20)
    told = linkage.generate_pairs(s1, targets, truth, str(tmp_path / "pairs"), how, entities=30, held_out=6)
    shards = R.scan_shards(spark, str(tmp_path / "pairs"))
    assert told["entities"] == 30 and set(told["countries"]) == {"US", "INDIA"} and sum(c["pairs"] for c in told["countries"].values()) == shards.count()
    assert set(features.ALL_FEATURES) <= set(shards.columns) and shards.select("s1_id").distinct().count() <= 30 and (tmp_path / "pairs" / "country=US").exists()
    judged = sampling.stratified_sample(sampling.entities_with_flag(s1, truth), 6)
    assert shards.join(judged, shards["s1_id"] == judged["entity_id"]).count() == 0
    models.PRESETS["tiny"] = models.Preset(3, 3, 0.3, 3, 2, 4)
    _, result = linkage.train(s1, targets, truth, 10, "tiny", linkage.Candidates(k=8), shards=shards)
    assert result["auc"] > 0.8


def test_mined_spellings_in_blocking(spark):
    s1 = recs(spark, [("S1-1", "Zunder Traiding", "5 Hill Road, Bandraa", "India"), ("S1-2", "Traiding Post", None, "US")])
    t = recs(spark, [("S2-1", "Big Trading", "7 Lake Road, Bandra", "India"), ("S2-2", "Trading Post", None, "US")])
    rules = spark.createDataFrame([("INDIA", "traiding", "trading"), ("INDIA", "bandraa", "bandra")], "country string, variant string, canonical string")
    parts = {r["entity_id"]: r for r in blocking.key_parts(s1, rules=rules).collect()}
    assert parts["S1-1"]["toks"] == ["zunder", "trading"] and parts["S1-1"]["clean"] == "zunder traiding" and parts["S1-1"]["print_addr"] == ["hill", "bandra"]
    assert parts["S1-2"]["toks"] == ["traiding", "post"]  # another country's rule
    found = lambda **how: {(r["s1_id"], r["cand_id"]) for r in linkage.Candidates(generation=2, k=5, **how).find(s1, t).collect()}
    assert ("S1-1", "S2-1") in found(rules=rules)
    keys = lambda rules: {r["key"] for r in blocking.keys_v2(blocking.key_parts(s1, rules=rules), False).collect()}
    assert "tok_n_INDIA_trading" in keys(rules) - keys(None) and "tok_a_INDIA_bandra" in keys(rules) - keys(None)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from kinweave import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    for kind in ("train", "test"):
        (tmp_path / kind).mkdir()
        head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
        (tmp_path / kind / f"{kind}_source1.tsv").write_text(head + "".join(f"S1-{i:03d}\tAlpha{i} Beta Works\t{i} Oak Street, {10000 + i}\tUS\n" for i in range(40)))
        (tmp_path / kind / f"{kind}_source2.tsv").write_text(head + "".join(f"S2-{i:03d}\tAlpha{i} Beta Wrks\t{i} Oak St, {10000 + i}\tUSA\n" for i in range(40)))
        (tmp_path / kind / f"{kind}_source3.tsv").write_text(head + "S3-001\tGamma\t\tUS\n")
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i:03d}\tS2-{i:03d}\n" for i in range(40)))
    models.PRESETS["tiny"] = models.Preset(3, 3, 0.3)
    out = str(tmp_path / "output")
    run = lambda words: cli.main([*words, "--train", str(tmp_path / "train"), "--test", str(tmp_path / "test"), "--out", out, "--model", str(tmp_path / "model")])
    assert run(["mine"]) == 0 and [tuple(r) for r in R.scan_rules(spark, f"{out}/variants").collect()] == [("US", "wrks", "works")]
    assert run(["pairs", "--entities", "25", "--per-country", "6"]) == 0
    assert run(["train", "--preset", "tiny", "--val-size", "8", "--pairs", f"{out}/pairs", "--rules", f"{out}/variants"]) == 0
    assert run(["package"]) == 1 and not list(tmp_path.glob("*.zip"))  # nothing valid yet
    assert run(["predict"]) == 0 and run(["validate", "--check-ids"]) == 0
    assert run(["evaluate", "--score", "--per-country", "12"]) == 0
    assert json.loads(spark.read.text(f"{out}/evaluation.json").first()[0])["US"]["recall_of_all"] == 1.0
    (tmp_path / "notes.md").write_text("x")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    assert run(["package", "--team", "t", "--doc", "notes.md", "--code", "src"]) == 0
    with zipfile.ZipFile(tmp_path / "t_submission.zip") as z:
        assert z.namelist() == ["output/matching_results.tsv", "output/candidate_pairs.tsv", "notes.md", "code/src/a.py"]
        assert len(z.read("output/matching_results.tsv").splitlines()) == 41


def test_stream(spark, sides, tmp_path):
    from kinweave.streaming import incremental

    s1, targets = sides
    incremental.store_index(targets, str(tmp_path / "index"))
    s1.write.parquet(str(tmp_path / "in"))
    q = incremental.link_stream(spark.readStream.schema(R.RECORD).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "ck"), k=5)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("s1_id", "cand_id", "rank")
    want = blocking.block_v1(s1, targets, 300, 5, "truncate").select("s1_id", "cand_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_training_rows_are_a_table(spark, monkeypatch):
    """Nothing is cached beside the trees' own rows, which a small executor would write to its disk; no table stays."""
    from pyspark.sql import DataFrame

    from kinweave.sources import staging

    def refused(*_):
        raise AssertionError("cached")

    monkeypatch.setattr(DataFrame, "persist", refused)
    made = list(staging._made)
    rows = spark.range(80).select(F.format_string("S1-%02d", F.col("id") % 20).alias("s1_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") % 3 / 10).alias("x"), F.lit(2).alias("times"))
    model = models.train(rows, ["x"], models.Preset(2, 2, 0.3, 2, 2))
    assert model.forest and model.meta and staging._made == made
    assert models.auc(models.score(model, rows)) == 1.0
    assert models.train(rows.drop("times"), ["x"], models.Preset(2, 2, 0.3)).meta is None
