"""End-to-end plans: split, generate pairs, train, predict, evaluate, mine."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assignment, blocking, features, labels, metrics, mining, models, sampling, weights
from ..operators.represent import represent, with_phonetics
from ..sources import records as R
from ..sources import sinks, staging


@dataclass
class Candidates:
    """How candidates are found: ``generation`` 1 has static weights, 2 IDF weights, mined spellings and re-ranking."""

    generation: int = 1
    policy: str = "truncate"
    cap: int = 300
    k: int = 35
    overgenerate: int = blocking.OVERGENERATE
    scripts: str = "all"
    caps: dict[str, int] | None = None  # of the second generation; None: those of use
    rules: DataFrame | None = None  # country, variant, canonical

    def find(self, s1: DataFrame, targets: DataFrame) -> DataFrame:
        """s1_id, cand_id, rank, score."""
        if self.generation == 1:
            return blocking.block_v1(s1, targets, self.cap, self.k, self.policy, self.scripts).select("s1_id", "cand_id", "rank", "score")
        # Both sides' key parts are stored: keys, boosts, terms and texts are all made of them.
        q, t = (staging.table(blocking.key_parts(x, self.scripts, self.rules)) for x in (s1, targets))
        return blocking.block_rerank(q, t, self.k, self.overgenerate, self.caps).select("s1_id", "cand_id", "rank", F.col("final").alias("score"))

    def told(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "rules"} | {"rules": self.rules is not None}


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, enhanced: bool = True, scripts: str = "all") -> DataFrame:
    """All features of ``pairs``; weights are fitted on the whole target pool, whatever its countries."""
    a, b = represent(s1, scripts), represent(targets, scripts)
    if not enhanced:
        return features.features(pairs, a, b)
    a, b = with_phonetics(a), with_phonetics(b)
    return features.features(pairs, a, b, (weights.fit_idf(b, "name_tokens"), weights.fit_idf(b, "addr_tokens")))


def training_pairs(s1: DataFrame, targets: DataFrame, truth: DataFrame, how: Candidates, preset: models.Preset, enhanced: bool = True) -> DataFrame:
    """Labelled features: retrieved pairs, forced positives, and of the negatives the hardest if the preset says so."""
    found = how.find(s1, targets)
    forced = labels.force_positives(found, truth, targets).join(found.select("s1_id", "cand_id", "score"), ["s1_id", "cand_id"], "left").na.fill(0.0, ["score"])
    made = labels.label(pair_features(forced, s1, targets, enhanced, how.scripts), truth)
    return labels.hard_negatives(made, preset.negatives) if preset.negatives else made


def generate_pairs(s1: DataFrame, targets: DataFrame, truth: DataFrame, path: str, how: Candidates | None = None, entities: int = 500_000, held_out: int = 3000, seed: int = 42) -> dict:
    """Labelled features of ``entities`` sampled S1 records as zstd shards by country, and what was written.

    The entities that ``harness`` evaluates on (``held_out`` of each country) are left out.
    """
    how = how or Candidates(generation=2, k=60, overgenerate=120, caps={"exact": 20_000, "key": 1500})
    judged = sampling.stratified_sample(sampling.entities_with_flag(s1, truth), held_out, seed)
    pool = s1.join(judged.select("entity_id"), "entity_id", "left_anti")
    picked = staging.table(sampling.sample_n(pool, entities, seed=seed))
    found = staging.table(how.find(picked, targets))
    made = labels.label(pair_features(found, picked, targets, True, how.scripts), truth)
    country = represent(picked, how.scripts).select(F.col("entity_id").alias("s1_id"), "country")
    sinks.write_shards(made.join(country, "s1_id"), path)
    written = R.scan_shards(s1.sparkSession, path).groupBy("country").agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("positives"))
    return {"entities": picked.count(), "countries": {r["country"]: {"pairs": r["pairs"], "positives": r["positives"]} for r in written.collect()}, "candidates": how.told()}


def split(s1: DataFrame, truth: DataFrame, val_size: int = 50_000, seed: int = 42) -> DataFrame:
    return sampling.stratified_split(sampling.entities_with_flag(s1, truth), val_size, seed)


def train(s1: DataFrame, targets: DataFrame, truth: DataFrame, val_size: int = 50_000, preset: str = "stack_v6", how: Candidates | None = None, enhanced: bool = True, shards: DataFrame | None = None) -> tuple[models.Matcher, dict]:
    """A matcher with thresholds that were swept on the validation entities, and its metrics.

    ``shards``: pairs of ``generate_pairs``; those of validation entities are not trained on.
    """
    p = models.PRESETS[preset]
    how = how or Candidates(cap=p.cap, k=p.k)
    parts = split(s1, truth, val_size)
    of = lambda name: s1.join(parts.filter(F.col("split") == name).select("entity_id"), "entity_id", "left_semi")
    columns = features.ALL_FEATURES if enhanced else features.BASE_FEATURES
    val = of("val")
    if shards is None:
        pairs = training_pairs(of("train"), targets, truth, how, p, enhanced)
    else:
        pairs = shards.join(val.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_anti").select("s1_id", "cand_id", "label", *columns)
        pairs = labels.hard_negatives(pairs, p.negatives) if p.negatives else pairs
    matcher = models.train(pairs, columns, p)
    scored = models.score(matcher, labels.label(pair_features(how.find(val, targets), val, targets, enhanced, how.scripts), truth)).select("s1_id", "cand_id", "label", "prob").persist()
    reps = represent(val, how.scripts).select("entity_id", "country")
    swept = assignment.sweep(scored, truth, reps, assignment.grid(0.50, 0.94, 0.02), by_country=True).persist()
    chosen = assignment.choose_thresholds(swept).collect()  # one row a country
    matcher.thresholds = {r["country"]: r["threshold"] for r in chosen}
    if chosen:
        matcher.global_threshold = chosen[0]["global_threshold"]
    result = evaluate(reps, truth, resolve(scored, reps, matcher))
    result |= {"auc": models.auc(scored), "importance": models.importance(matcher), "candidates": how.told()}
    scored.unpersist()
    swept.unpersist()
    return matcher, result


def resolve(scored: DataFrame, s1: DataFrame, matcher: models.Matcher, slack: bool = False) -> DataFrame:
    """Matches at each country's threshold; countries that were never swept use the global one.

    ``slack``: low pairs go first, so that they no longer count when an entity's only pair needs a margin.
    """
    known = F.create_map(*[F.lit(x) for kv in matcher.thresholds.items() for x in kv]) if matcher.thresholds else None
    limit = F.lit(matcher.global_threshold) if known is None else F.coalesce(F.try_element_at(known, F.col("country")), F.lit(matcher.global_threshold))
    pairs = scored.select("s1_id", "cand_id", "prob").join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").withColumn("limit", limit)
    if slack:
        pairs = pairs.filter(F.col("prob") >= F.greatest(F.lit(0.20), F.col("limit") - 0.15))
    return assignment.assign(assignment.with_counts(pairs), F.col("limit")).select("s1_id", "cand_id", "prob")


def predict(s1: DataFrame, targets: DataFrame, matcher: models.Matcher, how: Candidates | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidate lists, match lists), one row for every S1 record each."""
    how = how or Candidates(cap=250, k=30)
    enhanced = len(matcher.columns) > len(features.BASE_FEATURES)
    found = how.find(s1, targets)
    if threshold is not None:
        matcher = models.Matcher(matcher.columns, matcher.boosted, matcher.forest, matcher.meta, {}, threshold)
    scored = models.score(matcher, pair_features(found, s1, targets, enhanced, how.scripts))
    matches = resolve(scored, represent(s1, how.scripts), matcher, slack=True)
    return sinks.candidate_lists(s1, found), sinks.match_lists(s1, matches)


def evaluate(s1: DataFrame, truth: DataFrame, matches: DataFrame) -> dict:
    return metrics.macro(metrics.per_entity(s1.select(F.col("entity_id").alias("s1_id")), truth, matches)).first().asDict()


def harness(s1: DataFrame, targets: DataFrame, truth: DataFrame, how: Candidates, matcher: models.Matcher | None = None, per_country: int = 3000, ks: tuple[int, ...] = (30, 60, 100), caps: tuple[int, ...] = (30, 100), seed: int = 42) -> dict:
    """By country, for sampled S1 records against the full target pool: recall at each k and over all candidates, how many
    candidates there are, why true pairs were missed, and, with a matcher, F0.5 of the links among the first ``caps``.

    The keys are the countries' normalised labels. All countries are found, scored and assigned in the same jobs.
    """
    columns = features.ALL_FEATURES if matcher is None else matcher.columns
    wide = replace(how, k=max(*ks, *caps, how.overgenerate if how.generation == 2 else how.k))
    mine = sampling.stratified_sample(sampling.entities_with_flag(s1, truth), per_country, seed).select("entity_id")
    sample = staging.table(s1.join(mine, "entity_id", "left_semi"))
    known = staging.table(represent(sample, how.scripts).select(F.col("entity_id").alias("s1_id"), "country"))
    found = staging.table(wide.find(sample, targets))
    true = truth.select("s1_id", "cand_id").distinct().join(known, "s1_id")
    ranked = true.join(found.select("s1_id", "cand_id", "rank"), ["s1_id", "cand_id"], "left")
    hits = ranked.groupBy("country").agg(F.count(F.lit(1)).alias("total_true_links"), F.count("rank").alias("all"), *[F.count_if(F.col("rank") < k).alias(f"k{k}") for k in ks])
    n = known.join(found.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left").na.fill(0, ["n"])
    counts = n.groupBy("country").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("n").alias("mean"), F.count_if(F.col("n") == 0).alias("none"))
    pools = represent(targets, how.scripts).groupBy("country").agg(F.count(F.lit(1)).alias("pool_size"))
    out: dict = {}
    for r in counts.join(hits, "country", "left").join(pools, "country", "left").collect():  # a row for each country
        total = r["total_true_links"] or 0
        share = lambda x, total=total: round((x or 0) / max(total, 1), 4)
        out[r["country"]] = {
            "pool_size": r["pool_size"] or 0, "n_entities": r["n_entities"], "total_true_links": total, "blocking_recall": {str(k): share(r[f"k{k}"]) for k in ks}, "recall_of_all": share(r["all"]),
            "mean_candidates": round(r["mean"], 3), "zero_candidates": r["none"],
        }
    for r in _missed(ranked.filter(F.col("rank").isNull()), sample, targets, how).groupBy("country", "why").count().collect():
        out[r["country"]].setdefault("missed", {})[r["why"]] = r["count"]
    if matcher is not None:
        enhanced = len(columns) > len(features.BASE_FEATURES)
        first = found.filter(F.col("rank") < max(caps))
        scored = staging.table(models.score(matcher, pair_features(first, sample, targets, enhanced, how.scripts)).select("s1_id", "cand_id", "prob").join(found.select("s1_id", "cand_id", "rank"), ["s1_id", "cand_id"]))
        reps = known.withColumnRenamed("s1_id", "entity_id")
        for cap in caps:
            links = resolve(scored.filter(F.col("rank") < cap), reps, matcher)
            for r in metrics.macro(metrics.per_entity(known, true.drop("country"), links), ("country",)).collect():
                out[r["country"]][f"end_to_end_cap{cap}"] = {"threshold": matcher.thresholds.get(r["country"], matcher.global_threshold), **{c: round(r[c], 4) for c in ("macro_f05", "macro_precision", "macro_recall", "singleton_accuracy")}}
    return out


def _missed(pairs: DataFrame, s1: DataFrame, targets: DataFrame, how: Candidates) -> DataFrame:
    """``pairs`` (s1_id, cand_id, country) with why: "other country", "no shared key" or, if they share one, "cut"."""
    keys = blocking.keys_v1 if how.generation == 1 else blocking.keys_v2
    a = s1.join(pairs.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    b = targets.join(pairs.select(F.col("cand_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    q, t = (blocking.key_parts(x, how.scripts, how.rules if how.generation == 2 else None) for x in (a, b))
    sides = lambda x, who, c: x.select(F.col("entity_id").alias(who), F.col("country").alias(c))
    shared = pairs.select("s1_id", "cand_id").join(keys(q).select(F.col("entity_id").alias("s1_id"), "key"), "s1_id").join(keys(t).select(F.col("entity_id").alias("cand_id"), "key"), ["cand_id", "key"]).select("s1_id", "cand_id").distinct().withColumn("met", F.lit(1))
    told = pairs.select("s1_id", "cand_id", "country").join(sides(t, "cand_id", "other"), "cand_id").join(shared, ["s1_id", "cand_id"], "left")
    why = F.when(F.col("met").isNotNull(), "cut").when(F.col("country") != F.col("other"), "other country").otherwise("no shared key")
    return told.withColumn("why", why)


def mine_variants(s1: DataFrame, targets: DataFrame, truth: DataFrame, least_n: int = 15, scripts: str = "all") -> DataFrame:
    """country, variant, canonical, n."""
    words = mining.mining_tokens(represent(R.union_targets(s1, targets), scripts))
    linked = mining.linked_words(truth, words)
    return mining.canonical_map(mining.variant_pairs(linked), mining.side_frequency(linked), least_n)
