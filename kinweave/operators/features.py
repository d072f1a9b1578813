"""Pair features: one select over candidate pairs joined to both representations.

26 are built-in expressions, 7 come from one Arrow-batched kernel (one crossing to Python per pair), 3 compare codes that
were computed per record, 6 come from the weighted terms that ``weights`` gives each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from . import weights

BUILT_IN = [
    "name_lev_ratio", "name_token_jaccard", "name_token_containment", "name_prefix4_match", "name_char3_jaccard", "name_exact_match", "name_comp_exact", "name_comp_substr",
    "name_acronym_match", "name_len_diff", "name_len_ratio", "addr_s1_missing", "addr_cand_missing", "addr_both_present", "addr_token_jaccard", "addr_token_containment",
    "addr_char3_jaccard", "pin_match", "pin_both_present", "pin_disagree", "st_num_match", "st_num_both_present", "st_num_disagree", "cand_source_is_s2", "cand_rank", "cand_blocking_score",
]
KERNEL = S.KERNELS
RELATIONAL = [f"{p}_{x}" for x in ("tfidf_cosine", "bm25", "max_shared_idf") for p in ("name", "addr")]
PHONETIC = ["name_metaphone_match", "name_soundex_match", "name_phonetic_token_ratio"]
BASE_FEATURES = [*BUILT_IN, *KERNEL]
ALL_FEATURES = [*BASE_FEATURES, *RELATIONAL, *PHONETIC]
#: The basic features by what they need: both names, both addresses, other facts of a pair.
OF_NAMES = [x for x in BASE_FEATURES if x.startswith("name_")]
OF_ADDRESSES = [x for x in BASE_FEATURES if x.startswith("addr_")]
OF_FACTS = [x for x in BASE_FEATURES if not x.startswith(("name_", "addr_"))]
IN_BLOCKS = [*OF_NAMES, *OF_ADDRESSES, *OF_FACTS]
_SIDE = ["entity_id", "country", "name_clean", "name_tokens", "name_set", "compressed", "acronym", "prefix4", "name_sorted", "name_char3", "addr_clean", "addr_set", "addr_char3", "postal", "street_no"]
_CODES = ["name_soundex", "name_metaphone", "name_codes"]
_TERMS = ["name_terms", "name_norm", "addr_terms", "addr_norm"]


def paired(pairs: DataFrame, s1: DataFrame, targets: DataFrame, phonetic: bool = False, terms: bool = False) -> DataFrame:
    """``pairs`` with the representations of both sides, as a_ and b_ columns."""
    columns = _SIDE + (_CODES if phonetic else []) + (_TERMS if terms else [])
    a = s1.select(*[F.col(c).alias(f"a_{c}") for c in columns])
    b = targets.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, pairs["s1_id"] == F.col("a_entity_id")).join(b, pairs["cand_id"] == F.col("b_entity_id"))


def built_in(rank: Column | None = None, score: Column | None = None) -> dict[str, Column]:
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    n1, n2 = F.char_length(a("name_clean")), F.char_length(b("name_clean"))
    filled = lambda x, y: (x != "") & (x == y)
    short_for = lambda x, y: (F.char_length(x("acronym")) >= 2) & ((x("acronym") == y("compressed")) | F.array_contains(y("name_set"), x("acronym")))
    both = (a("addr_clean") != "") & (b("addr_clean") != "")
    where_both = lambda x: F.when(both, x).otherwise(0.0)
    out = {
        "name_lev_ratio": S.levenshtein_similarity(a("name_clean"), b("name_clean")),
        "name_token_jaccard": S.jaccard(a("name_set"), b("name_set")),
        "name_token_containment": S.containment(a("name_set"), b("name_set")),
        "name_prefix4_match": S.flag(filled(a("prefix4"), b("prefix4"))),
        "name_char3_jaccard": S.jaccard(a("name_char3"), b("name_char3")),
        "name_exact_match": S.flag(filled(a("name_clean"), b("name_clean"))),
        "name_comp_exact": S.flag(filled(a("compressed"), b("compressed"))),
        "name_comp_substr": S.flag((a("compressed") != "") & (b("compressed") != "") & (F.contains(a("compressed"), b("compressed")) | F.contains(b("compressed"), a("compressed")))),
        "name_acronym_match": S.flag(short_for(a, b) | short_for(b, a)),
        "name_len_diff": F.abs(n1 - n2).cast("double"),
        "name_len_ratio": F.least(n1, n2) / F.greatest(n1, n2, F.lit(1)),
        "addr_s1_missing": S.flag(a("addr_clean") == ""),
        "addr_cand_missing": S.flag(b("addr_clean") == ""),
        "addr_both_present": S.flag(both),
        "addr_token_jaccard": where_both(S.jaccard(a("addr_set"), b("addr_set"))),
        "addr_token_containment": where_both(S.containment(a("addr_set"), b("addr_set"))),
        "addr_char3_jaccard": where_both(S.jaccard(a("addr_char3"), b("addr_char3"))),
    }
    for name, x in (("pin", "postal"), ("st_num", "street_no")):
        out[f"{name}_match"] = S.agreement(a(x), b(x))
        out[f"{name}_both_present"] = S.flag(a(x).isNotNull() & b(x).isNotNull())
        out[f"{name}_disagree"] = S.flag(a(x) != b(x))
    out["cand_source_is_s2"] = S.flag(b("entity_id").startswith("S2-"))
    out["cand_rank"] = (F.lit(0) if rank is None else rank).cast("double")
    out["cand_blocking_score"] = (F.lit(1.0) if score is None else score).cast("double")
    return out


def phonetics() -> dict[str, Column]:
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    return {f"name_{k}_match": S.flag((a(f"name_{k}") != "") & (a(f"name_{k}") == b(f"name_{k}"))) for k in ("metaphone", "soundex")} | {"name_phonetic_token_ratio": S.phonetic_ratio(a("name_codes"), b("name_codes"))}


def built_in_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, cand_id and the built-in features; ``pairs`` has rank and score."""
    return paired(pairs, s1, targets).select("s1_id", "cand_id", *[x.alias(n) for n, x in built_in(F.col("rank"), F.col("score")).items()])


def features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, idf: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """s1_id, cand_id and all features; without ``idf`` (of names and of addresses) the 33 basic ones.

    For all 42, ``s1`` and ``targets`` come from ``represent.with_phonetics``.
    """
    columns = built_in(F.col("rank"), F.col("score"))
    if idf:
        fields = {"name": ("name_tokens", idf[0]), "addr": ("addr_tokens", idf[1])}
        s1, targets = (x.join(weights.vectors(x, fields), "entity_id", "left") for x in (s1, targets))
        columns |= phonetics() | weights.scores("name", "a_", "b_") | weights.scores("addr", "a_", "b_")
    rows = paired(pairs, s1, targets, phonetic=idf is not None, terms=idf is not None)
    kernels = S.pair_kernels("a_name_clean", "b_name_clean", "a_name_sorted", "b_name_sorted", "a_addr_clean", "b_addr_clean")
    out = rows.withColumn("k", kernels).select("s1_id", "cand_id", *[x.alias(n) for n, x in columns.items()], "k.*")
    return out.select("s1_id", "cand_id", *ALL_FEATURES) if idf else out


# The same features in blocks of queries (``blocks``), where they are made once for each two texts that meet there.


def _grams(text: str, n: int = 3) -> set[str]:
    return {text[i : i + n] for i in range(max(len(text) - n + 1, 1))} if text else set()


def _jaccard(x: set, y: set) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _containment(x: set, y: set) -> float:
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def name_shape(clean: str, acronym: str) -> tuple:
    """What ``name_values`` compares: ``clean``, tokens, compressed, acronym, n-grams, sorted."""
    tokens = clean.split(" ") if clean else []
    compressed = "".join(tokens)
    return clean, set(tokens), compressed, acronym, _grams(compressed), " ".join(sorted(tokens))


def address_shape(clean: str) -> tuple:
    """What ``address_values`` compares: ``clean``, tokens, n-grams, sorted."""
    tokens = clean.split(" ") if clean else []
    return clean, set(tokens), _grams("".join(tokens)), " ".join(sorted(tokens))


def name_values(a: tuple, b: tuple) -> tuple[float, ...]:
    """``OF_NAMES`` of two names."""
    x, x_tokens, x_comp, x_short, x_grams, x_sorted = a
    y, y_tokens, y_comp, y_short, y_grams, y_sorted = b
    longest = max(len(x), len(y))
    short = len(x_short) >= 2 and (x_short == y_comp or x_short in y_tokens) or len(y_short) >= 2 and (y_short == x_comp or y_short in x_tokens)
    return (
        1 - S.levenshtein(x, y) / longest if longest else 1.0, _jaccard(x_tokens, y_tokens), _containment(x_tokens, y_tokens), float(x[:4] == y[:4] != ""), _jaccard(x_grams, y_grams),
        float(x == y != ""), float(x_comp == y_comp != ""), float(x_comp != "" and y_comp != "" and (x_comp in y_comp or y_comp in x_comp)), float(short),
        float(abs(len(x) - len(y))), min(len(x), len(y)) / max(longest, 1), S.jaro_winkler(x, y), S.indel(x_sorted, y_sorted), S.token_set_of(x_tokens, y_tokens), S.jaro_winkler(x_sorted, y_sorted),
    )


def address_values(a: tuple, b: tuple) -> tuple[float, ...]:
    """``OF_ADDRESSES`` of two addresses."""
    (x, x_tokens, x_grams, x_sorted), (y, y_tokens, y_grams, y_sorted) = a, b
    if not x or not y:
        return float(not x), float(not y), *[0.0] * 7
    return 0.0, 0.0, 1.0, _jaccard(x_tokens, y_tokens), _containment(x_tokens, y_tokens), _jaccard(x_grams, y_grams), S.jaro_winkler(x, y), S.indel(x_sorted, y_sorted), S.token_set_of(x_tokens, y_tokens)
