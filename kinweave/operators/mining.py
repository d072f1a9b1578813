"""Spelling variants mined from true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X

MOST_RULES = 50_000


def mining_tokens(represented: DataFrame) -> DataFrame:
    """entity_id, country, words: the name's telling tokens of three letters and more."""
    return represented.select("entity_id", "country", F.array_distinct(X.without(F.col("name_tokens"), L.NAME_STOP + L.LEGAL + L.CORE_STOP_V2, 3)).alias("words"))


def linked_words(truth: DataFrame, words: DataFrame) -> DataFrame:
    """s1_id, cand_id, country (of S1), a, b: both sides' words, where both have any."""
    a = words.select(F.col("entity_id").alias("s1_id"), "country", F.col("words").alias("a"))
    b = words.select(F.col("entity_id").alias("cand_id"), F.col("words").alias("b"))
    return truth.join(a, "s1_id").join(b, "cand_id").filter((F.size("a") > 0) & (F.size("b") > 0))


def variant_pairs(linked: DataFrame, sounds: bool = True) -> DataFrame:
    """country, x, y, n: unordered pairs of words that stand on one side each, of about equal length, sound and spelling.

    Words are paired within one link only, so the pairs are bounded by the lengths of two names.
    """
    only = linked.select("country", F.array_except("a", "b").alias("a"), F.array_except("b", "a").alias("b"))
    pairs = only.withColumn("x0", F.explode("a")).withColumn("y0", F.explode("b")).filter((F.abs(F.char_length("x0") - F.char_length("y0")) <= 2) & (F.levenshtein("x0", "y0", 2) >= 0))
    if sounds:
        from ..functions.similarity import soundex_code

        pairs = pairs.filter(soundex_code("x0") == soundex_code("y0"))
    return pairs.groupBy("country", F.least("x0", "y0").alias("x"), F.greatest("x0", "y0").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def side_frequency(linked: DataFrame) -> DataFrame:
    """country, term, df: link sides that hold the word."""
    return linked.select("country", F.explode(F.concat("a", "b")).alias("term")).groupBy("country", "term").agg(F.count(F.lit(1)).alias("df"))


def canonical_map(pairs: DataFrame, frequency: DataFrame, least_n: int = 15, most: int = MOST_RULES) -> DataFrame:
    """country, variant, canonical, n: the rarer word of a pair is the variant (on ties the later one in order).

    A variant keeps its most frequent pair; each country keeps its ``most`` rules of highest n. Ties in word order.
    """
    f = lambda side: frequency.select("country", F.col("term").alias(side), F.col("df").alias(f"d{side}"))
    both = pairs.filter(F.col("n") >= least_n).join(f("x"), ["country", "x"], "left").join(f("y"), ["country", "y"], "left").na.fill(0, ["dx", "dy"])
    ruled = both.select("country", F.when(F.col("dx") >= F.col("dy"), F.col("y")).otherwise(F.col("x")).alias("variant"), F.when(F.col("dx") >= F.col("dy"), F.col("x")).otherwise(F.col("y")).alias("canonical"), "n")
    ruled = ruled.filter((F.char_length("variant") >= 4) & (F.char_length("canonical") >= 4))
    one = ruled.withColumn("place", F.row_number().over(Window.partitionBy("country", "variant").orderBy(F.desc("n"), "canonical"))).filter("place = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "variant"))).filter(F.col("place") <= most).drop("place")


def apply_map(words: DataFrame, rules: DataFrame, *columns: str) -> DataFrame:
    """``words`` (entity_id, country, ...) with the columns' tokens replaced by their canonical forms, order kept.

    ``rules`` are at most ``MOST_RULES`` a country, so they are broadcast; all columns share one grouping.
    """
    columns = columns or ("name_tokens",)
    place = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("ts")) for i, c in enumerate(columns)])
    each = words.select("entity_id", "country", F.inline(place)).select("entity_id", "country", "i", F.posexplode("ts").alias("pos", "variant"))
    new = each.join(F.broadcast(rules.select("country", "variant", "canonical")), ["country", "variant"], "left").select("entity_id", "i", "pos", "canonical", "variant")
    # Only records with a variant are grouped; the others keep their tokens.
    hit = new.join(new.filter(F.col("canonical").isNotNull()).select("entity_id").distinct(), "entity_id", "left_semi")
    entry = lambda i: F.when(F.col("i") == i, F.struct("pos", F.coalesce("canonical", "variant").alias("t")))
    lists = hit.groupBy("entity_id").agg(*[F.array_sort(F.collect_list(entry(i))).alias(f"kw_{i}") for i in range(len(columns))])
    out = words.join(lists, "entity_id", "left")
    return out.withColumns({c: F.when(F.col(f"kw_{i}").isNull(), F.col(c)).otherwise(F.transform(f"kw_{i}", lambda x: x["t"])) for i, c in enumerate(columns)}).drop(*[f"kw_{i}" for i in range(len(columns))])
