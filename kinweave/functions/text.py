"""Normalisation of names, addresses and countries as column expressions.

Everything runs in the JVM.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .scripts import romanised, sound

#: Latin letters that become two ASCII letters; fixed values.
TWO_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
#: Latin letters without a decomposition; fixed values.
ONE_LETTER = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "ð": "d", "Ð": "D"}


@functools.cache
def _latin_table() -> tuple[str, str]:
    """Accented Latin letters and what they fold to, by their canonical decomposition."""
    pairs = dict(ONE_LETTER)
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            pairs[chr(cp)] = base[0]
    return "".join(pairs), "".join(pairs.values())


def fold_latin(x: Column) -> Column:
    """Accents off, ligatures apart; ASCII text passes through ``translate`` untouched."""
    for letter, two in TWO_LETTERS.items():
        x = F.replace(x, F.lit(letter), F.lit(two))
    return F.translate(x, *_latin_table())


def romanise(text: str) -> str:
    """``transliterate`` for a single text."""
    return "".join(TWO_LETTERS.get(c) or ONE_LETTER.get(c) or sound(c) for c in text)


#: Whatever ``fold_latin`` leaves: letters and marks beyond Latin, and compatibility forms.
OTHER_SCRIPT = r"[^\x{0}-\x{24F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}]"


def transliterate(x: Column) -> Column:
    """As ``fold_latin``, and other scripts by the sounds of their letters; both in the JVM."""
    return fold_latin(F.when(x.rlike(OTHER_SCRIPT), romanised(x)).otherwise(x))


def basic_clean(x: Column, scripts: str = "all") -> Column:
    """Lower-cased ASCII with "and" for "&"; ``scripts="latin"`` leaves other scripts as they are."""
    x = F.coalesce(x, F.lit(""))
    return F.replace(F.lower(transliterate(x) if scripts == "all" else fold_latin(x)), F.lit("&"), F.lit(" and "))


def literal_map(words: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*map(F.lit, words.values())))


def tokens(x: Column) -> Column:
    """Words, without the empty ones that a split leaves at the ends."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def no_punctuation(x: Column) -> Column:
    """Blanks for what is neither a letter (of any script) nor a digit."""
    return F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_\s]", " ")


def mapped(words: Column, table: dict[str, str]) -> Column:
    m = literal_map(table)
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(m, t), t))


def name_tokens(cleaned: Column) -> Column:
    """Tokens of a ``basic_clean`` name, legal forms in their canonical spelling."""
    return mapped(tokens(no_punctuation(F.regexp_replace(cleaned, L.NAME_DOMAIN, " "))), L.LEGAL_MAP)


def address_tokens(cleaned: Column) -> Column:
    return mapped(tokens(no_punctuation(cleaned)), L.ADDRESS_MAP)


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def found(x: Column, pattern: str) -> Column:
    """The first group of the leftmost match, or null."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def postal_code(cleaned: Column) -> Column:
    return F.translate(found(cleaned, L.POSTAL), "- ", "")


def street_number(cleaned: Column) -> Column:
    return found(cleaned, L.STREET_NUMBER)


def landmark(cleaned: Column) -> Column:
    return F.trim(found(cleaned, L.LANDMARK))


def plot_number(raw: Column) -> Column:
    return found(raw, L.PLOT)


def country(x: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    out = c
    for label, spellings in L.COUNTRY_SPELLINGS.items():
        out = F.when(c.isin(spellings), label).otherwise(out)
    return out


def strip_domain(x: Column) -> Column:
    """A name without leading noise, web prefix and domain endings, lower-cased."""
    x = F.btrim(F.lower(F.coalesce(x, F.lit(""))), F.lit(" \t\n\r\f\v"))
    for pattern in (L.LEADING_NOISE, L.DOMAIN_PREFIX, L.DOMAIN_SUFFIX, L.DOMAIN_UNSPACED):
        x = F.regexp_replace(x, pattern, "")
    return x


def without(words: Column, stop: list[str], least: int = 0) -> Column:
    """The words that are no stop words and have ``least`` letters."""
    return F.filter(words, lambda t: ~t.isin(stop) & (F.char_length(t) >= least))


def rare_address_tokens(raw: Column, least: int = 3, most: int = 4) -> Column:
    """The first few telling tokens of the raw lower-cased address; letters of any script count as letters."""
    words = tokens(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"(?U)[^\w\s]", " "))
    return F.slice(F.filter(without(words, L.ADDRESS_STOP, least), lambda t: ~t.rlike(r"^\d+$")), 1, most)


def id_list(x: Column) -> Column:
    """The distinct trimmed ids of a comma list; null is an empty list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))


def char_ngrams(x: Column, n: int = 3) -> Column:
    """The set of n-grams; the text itself if it is shorter; empty for an empty text."""
    size = F.char_length(x)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))
