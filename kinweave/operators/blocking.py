"""Candidate generation: blocking keys, posting policies, weighted retrieval and re-ranking.

A key joins the records of both sides that have it. The posting list of a key is the bag of targets with it, in id order;
lists beyond a cap are skipped whole (``drop``) or cut to their first rows (``truncate``). That bounds the join: no key
brings more than cap x its queries, and no pair of sides is ever crossed. Country is part of every key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..sources import staging
from . import blocks, features, mining
from .represent import acronym

# Weights of the first key set.
STATIC_WEIGHT = {"nm": 3, "cp": 3, "cr": 3, "sc": 3, "tok": 1}
# Base weights and caps of the second key set, by class.
EXACT, COMPOSITE, TOKEN, ADDRESS, PHONETIC = 4.0, 3.0, 2.0, 2.0, 1.5
# Boosts for equal postal codes, street numbers and shared address tokens; posting caps and pairs that go to the
# re-ranking; weights of the final blend.
BOOST_POSTAL, BOOST_STREET, BOOST_TOKEN, MOST_TOKENS = 2.0, 1.5, 0.5, 2
CAPS, OVERGENERATE = {"exact": 20_000, "key": 5_000}, 800
BLEND_COSINE, BLEND_NAME, BLEND_ADDRESS, BLEND_KEYS, COSINE_GAIN = 0.40, 0.0, 0.20, 0.40, 1.4
FEATURED = ", ".join(["ids array<string>, s1_id string, cand_id string, owner string", *[f"{x} double" for x in features.IN_BLOCKS]])


def key_parts(records: DataFrame, scripts: str = "all", rules: DataFrame | None = None, shown: bool = False) -> DataFrame:
    """What keys are made of: entity_id, country, toks, clean, comp, core (and core2), postal, street_no, plot, rare tokens.

    ``rules`` (country, variant, canonical): mined spellings, put in place of the variants among the name's tokens and the
    address' rare tokens; the whole names (clean, comp) stay as they are. Parts are returned unchanged.
    ``shown``: with rep, the texts that the features of pairs compare (name, acronym, addr), as ``represent`` has them.
    """
    if "toks" in records.columns:
        return records
    c = F.col
    r = records.select(
        "entity_id", X.country(c("country")).alias("country"), "business_address",
        X.name_tokens(X.basic_clean(X.strip_domain(c("business_name")), scripts)).alias("toks"), X.basic_clean(c("business_address"), scripts).alias("a"),
        *([X.name_tokens(X.basic_clean(c("business_name"), scripts)).alias("name_tokens")] if shown else []),
    )
    r = r.withColumns({
        "clean": F.array_join("toks", " "), "comp": F.array_join("toks", ""), "addr_tokens": X.address_tokens(c("a")), "postal": X.postal_code(c("a")), "street_no": X.street_number(c("a")),
        "plot": X.plot_number(F.coalesce("business_address", F.lit(""))), "print_addr": X.rare_address_tokens(c("business_address")),
    })
    if rules is not None:
        r = mining.apply_map(r, rules, "toks", "print_addr")
    return r.select(
        "entity_id", "country", "toks", "clean", "comp", "postal", "street_no", "plot", "addr_tokens",
        X.without(c("toks"), L.LEGAL + L.CORE_STOP_V1, 2).alias("core"),
        X.without(c("toks"), L.LEGAL + L.NAME_STOP + L.CORE_STOP_V2, 2).alias("core2"),
        X.without(c("toks"), L.LEGAL + L.NAME_STOP, 4).alias("rare_name"),
        X.without(c("toks"), L.LEGAL + L.NAME_STOP, 3).alias("rare_name2"),
        F.filter(X.without(c("addr_tokens"), L.ADDRESS_STOP, 4), lambda t: ~t.rlike(r"^\d+$")).alias("rare_addr"), "print_addr",
        *([F.struct(F.array_join("name_tokens", " ").alias("name"), acronym(c("name_tokens")).alias("acronym"), F.array_join("addr_tokens", " ").alias("addr")).alias("rep")] if shown else []),
    )


def _key(kind: str, condition: Column, *parts: Column | str, weight: float | None = None, cap: str = "key") -> Column:
    text = F.concat_ws("_", F.lit(kind), F.col("country"), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(condition, F.struct(F.lit(kind).alias("kind"), text.alias("key"), F.lit(float(weight if weight is not None else STATIC_WEIGHT.get(kind, 2))).alias("weight"), F.lit(cap).alias("cap_class")))


def _list(kind: str, words: Column, weight: float, cap: str = "key") -> Column:
    return F.transform(words, lambda t: F.struct(F.lit(kind).alias("kind"), F.concat_ws("_", F.lit(kind), F.col("country"), t).alias("key"), F.lit(float(weight)).alias("weight"), F.lit(cap).alias("cap_class")))


def keys_v1(parts: DataFrame) -> DataFrame:
    """entity_id, key_ord, kind, key, weight, cap_class: the first key set, in order, duplicates kept."""
    c, at = F.col, F.get
    t0, rare = at("toks", F.lit(0)), lambda i: at("rare_addr", F.lit(i))
    core, first_addr = F.array_join("core", ""), at("addr_tokens", F.lit(0))
    has = lambda x, n=1: F.coalesce(F.char_length(x) >= n, F.lit(False))
    listed = F.array(
        _key("nm", has(c("clean")), c("clean")),
        _key("cp", has(c("comp"), 3), c("comp")),
        _key("cr", has(core, 3), core),
        _key("sc", has(core, 3), F.array_join(F.array_sort("core"), "")),
        _key("f2", F.size("toks") >= 2, t0, at("toks", F.lit(1))),
        _key("f1", has(t0, 3) & ~t0.isin(L.NAME_STOP + L.LEGAL), t0),
        _key("pin", c("postal").isNotNull() & has(t0, 2), c("postal"), F.substring(t0, 1, 3)),
        _key("st_addr", c("street_no").isNotNull() & rare(0).isNotNull(), c("street_no"), rare(0)),
        _key("st_addr", c("street_no").isNotNull() & rare(1).isNotNull(), c("street_no"), rare(1)),
        _key("st_rd", c("street_no").isNotNull() & has(first_addr, 3) & (first_addr != c("street_no")) & ~first_addr.isin(L.ADDRESS_STOP), c("street_no"), F.substring(first_addr, 1, 4)),
        _key("st_nm", c("street_no").isNotNull() & has(c("comp"), 3), c("street_no"), F.substring("comp", 1, 3)),
        _key("plt", c("plot").isNotNull() & rare(0).isNotNull(), c("plot"), rare(0)),
    )
    return _exploded(parts, F.concat(F.array_compact(listed), _list("tok", c("rare_name"), STATIC_WEIGHT["tok"])))


def keys_v2(parts: DataFrame, phonetic: bool = True) -> DataFrame:
    """The second key set: exact names, names with address facts, address facts alone, single tokens, sounds."""
    c, at = F.col, F.get
    t0, first = at("toks", F.lit(0)), at("core2", F.lit(0))
    a = lambda i: at("print_addr", F.lit(i))
    core = F.array_join("core2", "")
    has = lambda x, n=1: F.coalesce(F.char_length(x) >= n, F.lit(False))
    both = lambda *xs: _all([x.isNotNull() for x in xs])
    listed = F.array(
        _key("nm", has(c("clean")), c("clean"), weight=EXACT, cap="exact"),
        _key("cp", has(c("comp"), 3), c("comp"), weight=EXACT, cap="exact"),
        _key("cr", has(core, 3), core, weight=EXACT, cap="exact"),
        _key("sc", has(core, 3), F.array_join(F.array_sort("core2"), ""), weight=EXACT, cap="exact"),
        _key("cmp", both(first, c("postal")), first, F.concat(F.lit("p"), c("postal")), weight=COMPOSITE),
        *[_key("cmp", both(first, a(i)), first, F.concat(F.lit("a"), a(i)), weight=COMPOSITE) for i in (0, 1)],
        _key("cmp", both(first, c("street_no")), first, F.concat(F.lit("s"), c("street_no")), weight=COMPOSITE),
        _key("cmp", both(t0, c("postal")), F.concat(F.lit("p"), c("postal")), F.substring(t0, 1, 3), weight=COMPOSITE),
        *[_key("cmp", both(a(i), c("street_no")), F.concat(F.lit("s"), c("street_no")), F.concat(F.lit("a"), a(i)), weight=COMPOSITE) for i in (0, 1)],
        _key("pin", both(c("postal")), c("postal"), weight=ADDRESS),
        _key("apair", both(a(1)), a(0), a(1), weight=ADDRESS),
    )
    lists = [F.array_compact(listed), _list("tok_n", c("rare_name2"), TOKEN), _list("tok_a", c("print_addr"), TOKEN)]
    if phonetic:
        from ..functions.similarity import soundex_codes

        parts = parts.withColumn("sounds", F.slice(F.array_distinct(soundex_codes(F.filter("core2", lambda t: F.char_length(t) >= 3))), 1, 3))
        lists.append(_list("ph", c("sounds"), PHONETIC))
    return _exploded(parts, F.concat(*lists))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out


def _exploded(parts: DataFrame, keys: Column) -> DataFrame:
    return parts.select("entity_id", "country", F.posexplode(keys).alias("key_ord", "k")).select("entity_id", "country", "key_ord", "k.*")


def postings(target_keys: DataFrame, caps: dict[str, int], policy: str = "drop") -> DataFrame:
    """key, cand_id, target_ord (place in the key's list), n_key (length of the list as it is used)."""
    rows = target_keys.select("key", "cap_class", F.col("entity_id").alias("cand_id"), "key_ord")
    cap = F.coalesce(*[F.when(F.col("cap_class") == k, F.lit(v)) for k, v in caps.items()])
    if policy == "drop":
        # Counted with a partial aggregate, so that a key of very many targets never meets in one task.
        good = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_key"), F.first("cap_class").alias("cap_class")).filter(F.col("n_key") <= cap).select("key", "n_key")
        return rows.join(good, "key").select("key", "cand_id", "key_ord", "n_key")
    if policy != "truncate":
        raise ValueError(f"policy: 'drop' or 'truncate', not {policy!r}")
    # The literal limit lets WindowGroupLimit keep the first rows of each key before the shuffle; lists are counted where they are cut.
    place = F.row_number().over(Window.partitionBy("key").orderBy("cand_id", "key_ord"))
    kept = rows.withColumn("place", place).filter((F.col("place") <= max(caps.values())) & (F.col("place") <= cap))
    return kept.withColumn("n_key", F.count(F.lit(1)).over(Window.partitionBy("key"))).select("key", "cand_id", "key_ord", "n_key")


def retrieve(query_keys: DataFrame, posting: DataFrame, k: int, weight: Column | None = None) -> DataFrame:
    """s1_id, cand_id, score, best_key, first_ord, rank (0-based): the top ``k`` by score, ties in first-seen order."""
    w = F.col("weight") if weight is None else weight
    hits = query_keys.select(F.col("entity_id").alias("s1_id"), "country", F.col("key_ord").alias("q_ord"), "key", "weight").join(posting, "key")
    scored = hits.withColumn("w", w).groupBy("s1_id", "cand_id").agg(F.sum("w").alias("score"), F.max("w").alias("best_key"), F.min("q_ord").alias("first_ord"))
    return top(scored, k, F.desc("score"), "first_ord", "cand_id")


def top(pairs: DataFrame, k: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(*order)) - 1
    return pairs.withColumn("rank", rank).filter(F.col("rank") < k)


def block_v1(queries: DataFrame, targets: DataFrame, cap: int, k: int, policy: str = "drop", scripts: str = "all") -> DataFrame:
    """Static weights. Defaults of use: drop 500/40, truncate 300/35."""
    posting = postings(keys_v1(key_parts(targets, scripts)), {"key": cap}, policy)
    return retrieve(keys_v1(key_parts(queries, scripts)), posting, k)


def featured_v1(queries: DataFrame, targets: DataFrame, cap: int, k: int, policy: str = "drop", scripts: str = "all", owners: DataFrame | None = None) -> DataFrame:
    """The pairs of ``block_v1`` with their basic features, without a shuffle of pairs. Queries of equal name, address and
    country are one: ids (all of them, in order), s1_id (the first), cand_id, owner (``owners``: entity_id, owner of a target)."""

    def run(block: blocks.Block, row: dict) -> dict:
        rows, score, first, _ = block.hits(row["keys"], idf=False)
        at = blocks.first_places(k, score, first, rows)
        return {"cand_id": rows[at], "values": block.features(row, rows[at], score[at])}

    q, t = (key_parts(x, scripts, shown=True) for x in (queries, targets))
    t = t.join(owners, "entity_id", "left") if owners else t.withColumn("owner", F.lit(None).cast("string"))
    told = queries.select("entity_id", "business_name", "business_address", F.col("country").alias("raw_country"))
    made = blocks.retrieve(staging.table(q), staging.table(t), keys_v1, lambda x: postings(x, {"key": cap}, policy), run, FEATURED, apart=1, told=told)
    return made.select("ids", "s1_id", "cand_id", "owner", *features.BASE_FEATURES)


def idf_weights(query_keys: DataFrame, posting: DataFrame, targets_by_country: DataFrame) -> DataFrame:
    """The query's key weights times ln(1 + N / length of the list), N the country's number of targets."""
    lengths = posting.groupBy("key").agg(F.max("n_key").alias("n_key"))
    return query_keys.join(targets_by_country, "country").join(lengths, "key").withColumn("weight", F.col("weight") * F.log1p(F.col("n") / F.col("n_key"))).drop("n", "n_key")


def boosted(scored: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds what equal address facts are worth to ``score``."""
    q = queries.select(F.col("entity_id").alias("s1_id"), F.col("postal").alias("q_postal"), F.col("street_no").alias("q_street"), F.col("print_addr").alias("q_print"))
    t = targets.select(F.col("entity_id").alias("cand_id"), F.col("postal").alias("t_postal"), F.col("street_no").alias("t_street"), F.col("print_addr").alias("t_print"))
    # Shared tokens are counted over the target's list, as often as they stand there.
    shared = F.size(F.filter("t_print", lambda x: F.array_contains(F.col("q_print"), x)))
    plus = F.when(F.col("q_postal") == F.col("t_postal"), BOOST_POSTAL).otherwise(0.0) + F.when(F.col("q_street") == F.col("t_street"), BOOST_STREET).otherwise(0.0) + BOOST_TOKEN * F.least(shared, F.lit(MOST_TOKENS))
    return scored.join(q, "s1_id").join(t, "cand_id").withColumn("boost", plus).withColumn("score", F.col("score") + F.col("boost")).drop("q_postal", "q_street", "q_print", "t_postal", "t_street", "t_print")


def block_v2(queries: DataFrame, targets: DataFrame, overgenerate: int = OVERGENERATE, caps: dict[str, int] | None = None, phonetic: bool = True, scripts: str = "all", rules: DataFrame | None = None) -> DataFrame:
    """IDF-weighted retrieval with address boosts: the top ``overgenerate`` pairs of each query, with best_key.

    ``queries`` and ``targets`` are records, or their ``key_parts`` where these are needed again.
    """
    q, t = key_parts(queries, scripts, rules), key_parts(targets, scripts, rules)
    return _in_blocks(q, t, caps, phonetic, _over(overgenerate), blocks.PAIR, False)


def _over(overgenerate: int):
    def run(block: blocks.Block, row: dict) -> dict:
        rows, score, first, best = block.hits(row["keys"], idf=True)
        boost = block.boost(row, rows, (BOOST_POSTAL, BOOST_STREET, BOOST_TOKEN, MOST_TOKENS))
        score = score + boost
        at = blocks.first_places(overgenerate, score.round(9), first, rows)
        return {"cand_id": rows[at], "score": score[at], "first_ord": first[at], "boost": boost[at], "rank": np.arange(len(at)), "best_key": np.full(len(at), best)}

    return run


def block_cosines(queries: DataFrame, targets: DataFrame, overgenerate: int = OVERGENERATE, caps: dict[str, int] | None = None, phonetic: bool = True, scripts: str = "all", rules: DataFrame | None = None) -> DataFrame:
    """s1_id, cand_id, cosine: ``cosines`` of the pairs of ``block_v2``, without a shuffle of pairs."""
    over = _over(overgenerate)

    def run(block: blocks.Block, row: dict) -> dict:
        rows = over(block, row)["cand_id"]
        cosine = block.cosine(row, rows)
        return {"cand_id": rows[cosine > 0], "cosine": cosine[cosine > 0]}

    q, t = key_parts(queries, scripts, rules), key_parts(targets, scripts, rules)
    return _in_blocks(q, t, caps, phonetic, run, blocks.COSINE, True)


def block_rerank(queries: DataFrame, targets: DataFrame, k: int, overgenerate: int = OVERGENERATE, caps: dict[str, int] | None = None, phonetic: bool = True, scripts: str = "all", rules: DataFrame | None = None) -> DataFrame:
    """``rerank`` of the pairs of ``block_v2``, without a shuffle of pairs.

    A text kernel is at most 1, so the texts of pairs that stay behind the ``k`` best even then are not compared.
    """
    over = _over(overgenerate)
    top_score = BOOST_POSTAL + BOOST_STREET + BOOST_TOKEN * MOST_TOKENS

    def run(block: blocks.Block, row: dict) -> dict:
        x = over(block, row)
        rows, n = x["cand_id"], len(x["cand_id"])
        if not n:
            return x
        cosine, key_share = block.cosine(row, rows), np.minimum(x["score"] / (x["best_key"] + top_score), 1.0)
        blend = lambda at, name, addr: BLEND_COSINE * np.minimum(cosine[at] * COSINE_GAIN, 1.0) + BLEND_NAME * name + BLEND_ADDRESS * addr + BLEND_KEYS * key_share[at]
        at = np.arange(n)
        if n > k:
            least = np.partition(blend(at, 0.0, 0.0), n - k)[n - k]
            at = np.flatnonzero(blend(at, 1.0, 1.0) >= least - 1e-8)  # ranks go by nine digits
        addr = block.token_set("addr", row["addr"], rows[at])
        name = block.token_set("name", row["name"], rows[at]) if BLEND_NAME else np.zeros(len(at))
        final = blend(at, name, addr)
        best = blocks.first_places(k, final.round(9), rows[at])
        at, addr, final = at[best], addr[best], final[best]
        name = name[best] if BLEND_NAME else block.token_set("name", row["name"], rows[at])
        kept = {c: x[c][at] for c in ("cand_id", "score", "first_ord", "boost", "best_key")}
        return kept | {"cosine": cosine[at], "fuzzy_name": name, "fuzzy_addr": addr, "key_share": key_share[at], "final": final, "rank": np.arange(len(at))}

    q, t = key_parts(queries, scripts, rules), key_parts(targets, scripts, rules)
    return _in_blocks(q, t, caps, phonetic, run, blocks.RERANKED, True)


def _in_blocks(q: DataFrame, t: DataFrame, caps: dict[str, int] | None, phonetic: bool, run, schema: str, terms: bool) -> DataFrame:
    of = (lambda frequency: lambda p: term_vectors(p, frequency))(collection_frequency(t)) if terms else None
    return blocks.retrieve(q, t, lambda p: keys_v2(p, phonetic), lambda k: postings(k, caps or CAPS, "truncate"), run, schema, of)


def term_vectors(parts: DataFrame, frequency: DataFrame) -> DataFrame:
    """entity_id, terms (array of term, w), norm: name and address tokens, ln(1 + total / frequency) per occurrence."""
    words = F.concat(F.transform("toks", lambda t: F.concat(F.lit("n:"), t)), F.transform("addr_tokens", lambda t: F.concat(F.lit("a:"), t)))
    counted = parts.select("entity_id", "country", words.alias("words")).select("entity_id", "country", F.inline(F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda x: x == t)).alias("tf")))))
    field = F.substring("term", 1, 2).alias("field")
    totals = F.broadcast(frequency.groupBy("country", field).agg(F.sum("cf").alias("total")))  # two rows for each country
    w = F.col("tf") * F.log1p(F.coalesce("total", F.lit(1)) / F.coalesce("cf", F.lit(1)))
    raw = counted.join(frequency, ["country", "term"], "left").withColumn("field", field).join(totals, ["country", "field"], "left")
    lists = raw.groupBy("entity_id").agg(F.collect_list(F.struct("term", w.alias("w"))).alias("terms"))
    return lists.withColumn("norm", F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))


def collection_frequency(parts: DataFrame) -> DataFrame:
    """country, term, cf: occurrences (not documents) of each name (n:) and address (a:) token."""
    terms = parts.select("country", F.explode(F.concat(F.transform("toks", lambda t: F.concat(F.lit("n:"), t)), F.transform("addr_tokens", lambda t: F.concat(F.lit("a:"), t)))).alias("term"))
    return terms.groupBy("country", "term").agg(F.count(F.lit(1)).alias("cf"))


def _cosine(q: str, t: str) -> Column:
    """Of the columns {q}_terms, {q}_norm and {t}_terms, {t}_norm; null if a side has no terms."""
    there = F.map_from_arrays(F.transform(f"{t}_terms", lambda x: x["term"]), F.transform(f"{t}_terms", lambda x: x["w"]))
    dot = F.element_at(F.transform(F.array(there), lambda m: F.aggregate(f"{q}_terms", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(m, x["term"]), F.lit(0.0)))), 1)
    return F.try_divide(dot, F.col(f"{q}_norm") * F.col(f"{t}_norm"))


def _side(x: DataFrame, who: str, side: str) -> DataFrame:
    return x.select(F.col("entity_id").alias(who), *[F.col(c).alias(f"{side}_{c}") for c in x.columns if c != "entity_id"])


def cosines(pairs: DataFrame, q_terms: DataFrame, t_terms: DataFrame) -> DataFrame:
    """s1_id, cand_id, cosine: only pairs that share a term. ``q_terms`` and ``t_terms`` are ``term_vectors``."""
    both = pairs.select("s1_id", "cand_id").join(_side(q_terms, "s1_id", "q"), "s1_id").join(_side(t_terms, "cand_id", "t"), "cand_id")
    return both.select("s1_id", "cand_id", _cosine("q", "t").alias("cosine")).filter(F.col("cosine") > 0)


def rerank(candidates: DataFrame, queries: DataFrame, targets: DataFrame, k: int, scripts: str = "all", rules: DataFrame | None = None) -> DataFrame:
    """The top ``k`` of ``block_v2`` pairs by the blend of cosine, fuzzy address and key score; all parts stay in the row.

    A record's terms and texts are gathered once; a pair meets them by its two ids.
    """
    from ..functions.similarity import token_set_sim

    q, t = key_parts(queries, scripts, rules), key_parts(targets, scripts, rules)
    frequency = collection_frequency(t)
    texts = lambda p: p.select("entity_id", F.col("clean").alias("name"), F.array_join("addr_tokens", " ").alias("addr")).join(term_vectors(p, frequency), "entity_id", "left")
    top_score = BOOST_POSTAL + BOOST_STREET + BOOST_TOKEN * MOST_TOKENS
    rows = candidates.drop("rank").join(_side(texts(q), "s1_id", "q"), "s1_id").join(_side(texts(t), "cand_id", "t"), "cand_id")
    parts = {"cosine": F.coalesce(_cosine("q", "t"), F.lit(0.0)), "fuzzy_name": token_set_sim("q_name", "t_name"), "fuzzy_addr": token_set_sim("q_addr", "t_addr"), "key_share": F.least(F.col("score") / (F.col("best_key") + top_score), F.lit(1.0))}
    rows = rows.select(*[c for c in candidates.columns if c != "rank"], *[x.alias(n) for n, x in parts.items()])
    final = BLEND_COSINE * F.least(F.col("cosine") * COSINE_GAIN, F.lit(1.0)) + BLEND_NAME * F.col("fuzzy_name") + BLEND_ADDRESS * F.col("fuzzy_addr") + BLEND_KEYS * F.col("key_share")
    return top(rows.withColumn("final", final), k, F.desc(F.round("final", 9)), "cand_id")


def key_recall(query_keys: DataFrame, target_keys: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, hits, recall: true pairs that share a key of the kind; kind "any" over all."""
    q = query_keys.select(F.col("entity_id").alias("s1_id"), "kind", "key").distinct()
    t = target_keys.select(F.col("entity_id").alias("cand_id"), "key").distinct()
    hit = truth.join(q, "s1_id").join(t, ["cand_id", "key"])
    each = hit.select("kind", "s1_id", "cand_id").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("hits"))
    union = hit.select("s1_id", "cand_id").distinct().agg(F.count(F.lit(1)).alias("hits")).select(F.lit("any").alias("kind"), "hits")
    total = truth.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return each.unionByName(union).join(F.broadcast(total)).select("kind", "hits", (F.col("hits") / F.col("total")).alias("recall"))


def key_misses(query_keys: DataFrame, target_keys: DataFrame, truth: DataFrame, most: int = 10) -> DataFrame:
    """s1_id, cand_id: the first true pairs in order that share no key of any kind."""
    q = query_keys.select(F.col("entity_id").alias("s1_id"), "key")
    t = target_keys.select(F.col("entity_id").alias("cand_id"), "key")
    hit = truth.join(q, "s1_id").join(t, ["cand_id", "key"]).select("s1_id", "cand_id").distinct()
    return truth.select("s1_id", "cand_id").distinct().join(hit, ["s1_id", "cand_id"], "left_anti").orderBy("s1_id", "cand_id").limit(most)


def blend_grid(step: float = 0.2) -> list[tuple[float, float, float, float]]:
    """All weights of (cosine, name, address, keys) in steps that sum to 1."""
    n = round(1 / step)
    return [(a / n, b / n, c / n, (n - a - b - c) / n) for a in range(n + 1) for b in range(n + 1 - a) for c in range(n + 1 - a - b)]


def tune_blend(parts: DataFrame, truth: DataFrame, grid: list[tuple[float, float, float, float]] | None = None, ks: tuple[int, ...] = (30, 100)) -> DataFrame:
    """w_cosine, w_name, w_addr, w_keys, k, hits, recall for every blend. ``parts``: ``rerank`` rows, parts in their row.

    The grid is a literal array that is exploded in front of one window: one job for all blends.
    """
    names = ("w_cosine", "w_name", "w_addr", "w_keys")
    tried = parts.select("s1_id", "cand_id", "cosine", "fuzzy_name", "fuzzy_addr", "key_share", F.inline(F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, w)]) for w in (grid or blend_grid())])))
    final = F.col("w_cosine") * F.least(F.col("cosine") * COSINE_GAIN, F.lit(1.0)) + F.col("w_name") * F.col("fuzzy_name") + F.col("w_addr") * F.col("fuzzy_addr") + F.col("w_keys") * F.col("key_share")
    place = F.row_number().over(Window.partitionBy(*names, "s1_id").orderBy(F.desc(F.round(final, 9)), "cand_id"))
    ranked = tried.withColumn("place", place).filter(F.col("place") <= max(ks))
    true = truth.select("s1_id", "cand_id").distinct()
    hits = ranked.join(true.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy(*names).agg(*[F.count_if((F.col("place") <= k) & F.col("t").isNotNull()).alias(f"k{k}") for k in ks])
    total = true.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    each = hits.select(*names, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks])))
    return each.join(F.broadcast(total)).select(*names, "k", "hits", (F.col("hits") / F.col("total")).alias("recall"))
