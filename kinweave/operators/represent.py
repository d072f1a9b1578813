"""Records to representations: every derived column, computed once per record and never per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X


def acronym(tokens: Column) -> Column:
    """The initials of the tokens that count, or of all."""
    core, every = X.initials(X.without(tokens, L.ACRONYM_STOP)), X.initials(tokens)
    return F.when(core != "", core).otherwise(every)


def represent(records: DataFrame, scripts: str = "all") -> DataFrame:
    """entity_id, country and the normalised forms of name and address. ``scripts``: "all", or "latin" to leave other scripts as they are."""
    c = F.col
    r = records.select("entity_id", X.country(c("country")).alias("country"), X.basic_clean(c("business_name"), scripts).alias("n"), X.basic_clean(c("business_address"), scripts).alias("a"))
    r = r.select("entity_id", "country", X.name_tokens(c("n")).alias("name_tokens"), X.address_tokens(c("a")).alias("addr_tokens"), X.postal_code(c("a")).alias("postal"), X.street_number(c("a")).alias("street_no"), X.landmark(c("a")).alias("landmark"))
    r = r.withColumns({"name_clean": F.array_join("name_tokens", " "), "compressed": F.array_join("name_tokens", ""), "addr_clean": F.array_join("addr_tokens", " "), "addr_joined": F.array_join("addr_tokens", ""), "acronym_all": X.initials(c("name_tokens")), "acronym": acronym(c("name_tokens"))})
    return r.select(
        "entity_id", "country", "name_clean", "name_tokens", F.array_distinct("name_tokens").alias("name_set"), "compressed", "acronym_all",
        "acronym", F.substring("name_clean", 1, 4).alias("prefix4"), F.array_join(F.array_sort("name_tokens"), " ").alias("name_sorted"), X.char_ngrams(c("compressed")).alias("name_char3"),
        "addr_clean", "addr_tokens", F.array_distinct("addr_tokens").alias("addr_set"), X.char_ngrams(c("addr_joined")).alias("addr_char3"), "postal", "street_no", "landmark",
    )


def with_phonetics(r: DataFrame) -> DataFrame:
    """Codes of the whole name and of each token: one crossing to Python per record, so that pairs only compare."""
    from ..functions import similarity as S

    return r.withColumns({"name_soundex": S.soundex_code("name_clean"), "name_metaphone": S.metaphone_code("name_clean"), "name_codes": S.metaphone_codes("name_tokens")})
