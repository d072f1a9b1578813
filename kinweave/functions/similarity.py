"""Similarities of names and addresses: as expressions what the JVM can say, sounds included; the rest as one
Arrow-batched kernel over the distinct pairs of a batch, bit-parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets given as arrays: 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def agreement(a: Column, b: Column) -> Column:
    """1 if both are there and equal, -1 if both are there and differ, else 0."""
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(-1.0)


def jaro(a: str, b: str) -> float:
    """Bit-parallel: the places of ``b`` are the bits of a number."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    free, window, last = (1 << len(b)) - 1, (1 << (reach + 1)) - 1, len(a)
    common = []
    for i, c in enumerate(a):
        near = places.get(c, 0) & free & window
        if near:
            free ^= near & -near
            common.append(c)
        window = window << 1 | (i < reach)
    m = len(common)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(common, (c for c, unused in zip(b, format(free, "b").zfill(len(b))[::-1]) if unused == "0"))) // 2
    return (m / last + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """With the boost for a common prefix of up to four letters above a Jaro similarity of 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return s + prefix * weight * (1 - s)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def levenshtein(a: str, b: str) -> int:
    """Edits from ``a`` to ``b``, bit-parallel; the number that the expression gives."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = full, 0, len(a)
    for c in b:
        same = masks.get(c, 0)
        across = ((same & up) + up ^ up) | same
        more, less = down | ~(across | up) & full, up & across
        edits += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(same | down | more) & full, more & (same | down)
    return edits


def indel(a: str, b: str) -> float:
    """Share of letters that insertions and deletions leave in place; 1 for two empty texts."""
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of comparing the common words with each side's and the sides' own words with each other."""
    return token_set_of(set(a.split()), set(b.split()))


def token_set_of(x: set[str], y: set[str]) -> float:
    if not x or not y:
        return 0.0
    both, xs, ys = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not xs or not ys):
        return 1.0
    s = len(" ".join(both))
    sx, sy = s + bool(s) + len(xs), s + bool(s) + len(ys)
    distance = len(xs) + len(ys) - 2 * lcs(xs, ys)
    best = 1 - distance / (sx + sy)
    if both:
        best = max(best, 1 - (1 + len(xs)) / (s + sx), 1 - (1 + len(ys)) / (s + sy))
    return best


#: Digit classes of letters; fixed values.
SOUND_CLASS = {c: d for d, letters in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r")) for c in letters}


def soundex(word: str) -> str:
    """First letter and three digits; letters without a class do not part two letters of one class."""
    letters = [c for c in word.strip().lower() if "a" <= c <= "z"]
    if not letters:
        return ""
    code, last = letters[0].upper(), SOUND_CLASS.get(letters[0])
    for c in letters[1:]:
        d = SOUND_CLASS.get(c)
        if d and d != last:
            code += d
            if len(code) == 4:
                break
        last = d or last
    return code.ljust(4, "0")


_PLAIN = {"f": "F", "j": "J", "l": "L", "m": "M", "n": "N", "q": "K", "r": "R", "v": "F", "z": "S", "b": "B"}


def metaphone(word: str) -> str:
    """A simplified Metaphone of up to six codes."""
    w = ""
    for c in word.strip().lower():
        if "a" <= c <= "z" and not w.endswith(c):
            w += c
    if w[:2] in ("ae", "gn", "kn", "pn", "wr"):
        w = w[1:]
    codes: list[str] = []
    i = 0
    while i < len(w) and len(codes) < 6:
        c, after = w[i], w[i + 1 : i + 2]
        before, two, step, code = w[i - 1] if i else "", w[i + 1 : i + 3], 1, ""
        vowel_next = after != "" and after in "aeiou"
        if c in "aeiou":
            code = c.upper() if i == 0 else ""
        elif c in _PLAIN:
            code = _PLAIN[c]
        elif c == "c":
            code, step = ("X", 2) if after == "h" else ("S" if after and after in "iey" else "K", 1)
        elif c == "d":
            code = "" if after == "g" else "T"
        elif c == "g":
            if after == "h":
                code, step = "" if len(two) == 2 and two[1] not in "aeiou" else "K", 2
            elif after == "n":
                step = 2
            else:
                code = "K"
        elif c == "h":
            code = "H" if vowel_next and (not before or before not in "aeiou") else ""
        elif c == "k":
            code = "" if before == "c" else "K"
        elif c == "p":
            code, step = ("F", 2) if after == "h" else ("P", 1)
        elif c == "s":
            code, step = ("X", 2) if after == "h" or two in ("io", "ia") else ("S", 1)
        elif c == "t":
            code, step = ("0", 2) if after == "h" else ("X", 2) if two in ("io", "ia") else ("T", 1)
        elif c in "wy":
            code = c.upper() if vowel_next else ""
        elif c == "x":
            code = "KS"
        if code:
            codes.append(code)
        i += step
    return "".join(codes)


def _letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def _one(word: Column, of) -> Column:
    """``of`` applied to a lambda variable that is bound to the word's letters."""
    return F.element_at(F.transform(F.array(_letters(F.coalesce(word, F.lit("")))), of), 1)


def _soundex(w: Column) -> Column:
    classes = F.translate(w, "".join(SOUND_CLASS), "".join(SOUND_CLASS.values()))
    # Vowels, h, w and y don't part equal classes: without them, a digit that repeats the one before goes.
    first = F.translate(F.substring(classes, 1, 1), "aeiouhwy", "")
    digits = F.regexp_replace(F.concat(first, F.translate(F.substring(classes, 2, 1_000_000), "aeiouhwy", "")), r"(\d)\1+", "$1")
    own = F.substring(digits, F.char_length(first) + 1, F.lit(3))
    return F.when(w == "", "").otherwise(F.rpad(F.concat(F.upper(F.substring(w, 1, 1)), own), 4, "0"))


def _metaphone(word: Column) -> Column:
    once = F.regexp_replace(word, r"(.)\1+", "$1")
    return F.element_at(F.transform(F.array(F.regexp_replace(once, "^(?:a(?=e)|g(?=n)|k(?=n)|p(?=n)|w(?=r))", "")), _metaphone_of), 1)


def _metaphone_of(w: Column) -> Column:
    at = lambda i: F.substring(w, i, F.lit(1))

    def code(i: Column) -> Column:
        c, after, two = at(i), at(i + 1), F.substring(w, i + 1, F.lit(2))
        before = F.when(i > 1, at(i - 1)).otherwise("")
        vowel = lambda x: (x != "") & F.contains(F.lit("aeiou"), x)
        soft = (after != "") & F.contains(F.lit("iey"), after)
        taken = ((c == "h") & (before != "") & F.contains(F.lit("cgpst"), before)) | ((c == "n") & (before == "g"))
        out = F.when(taken, "").when(vowel(c), F.when(i == 1, F.upper(c)).otherwise(""))
        for plain, x in _PLAIN.items():
            out = out.when(c == plain, x)
        out = out.when(c == "c", F.when(after == "h", "X").when(soft, "S").otherwise("K"))
        out = out.when(c == "d", F.when(after == "g", "").otherwise("T"))
        silent = (F.char_length(two) == 2) & ~vowel(F.substring(two, 2, 1))
        out = out.when(c == "g", F.when(after == "h", F.when(silent, "").otherwise("K")).when(after == "n", "").otherwise("K"))
        out = out.when(c == "h", F.when(vowel(after) & ~vowel(before), "H").otherwise(""))
        out = out.when(c == "k", F.when(before == "c", "").otherwise("K"))
        out = out.when(c == "p", F.when(after == "h", "F").otherwise("P"))
        out = out.when(c == "s", F.when((after == "h") | two.isin("io", "ia"), "X").otherwise("S"))
        out = out.when(c == "t", F.when(after == "h", "0").when(two.isin("io", "ia"), "X").otherwise("T"))
        out = out.when(c.isin("w", "y"), F.when(vowel(after), F.upper(c)).otherwise(""))
        return out.when(c == "x", "KS").otherwise("")

    codes = F.filter(F.transform(F.sequence(F.lit(1), F.char_length(w)), code), lambda x: x != "")
    return F.when(w == "", "").otherwise(F.array_join(F.slice(codes, 1, 6), ""))


def soundex_code(word: Column | str) -> Column:
    """``soundex`` as an expression."""
    return _one(F.col(word) if isinstance(word, str) else word, _soundex)


def metaphone_code(word: Column | str) -> Column:
    """``metaphone`` as an expression. An h behind c, g, p, s or t and an n behind g belong to the code of the letter before,
    so each letter's code follows from its neighbours."""
    return _one(F.col(word) if isinstance(word, str) else word, _metaphone)


def soundex_codes(words: Column | str) -> Column:
    return F.transform(words, lambda w: _one(w, _soundex))


def metaphone_codes(words: Column | str) -> Column:
    return F.transform(words, lambda w: _one(w, _metaphone))


def phonetic_ratio(a: Column, b: Column) -> Column:
    """Share of the shorter list's codes that the other has (of equal lists the first's); empty codes count for nothing."""
    swap = F.size(a) > F.size(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    hits = F.size(F.filter(short, lambda x: (x != "") & F.array_contains(long, x)))
    return F.when(F.size(short) == 0, 0.0).otherwise(hits / F.size(short))


def _pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, f(p[0] or "", p[1] or "")) for p in zip(a, b)], dtype=float)

    return run


@F.pandas_udf(T.DoubleType())
def jaro_winkler_sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(jaro_winkler)(a, b)


@F.pandas_udf(T.DoubleType())
def token_sort_sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(token_sort)(a, b)


@F.pandas_udf(T.DoubleType())
def token_set_sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(token_set)(a, b)


def text_kernels(a: str, b: str) -> tuple[float, float, float]:
    return jaro_winkler(a, b), token_sort(a, b), token_set(a, b)


KERNELS = ["name_jw", "name_token_sort", "name_token_set", "name_sorted_jw", "addr_jw", "addr_token_sort", "addr_token_set"]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in KERNELS]))
def pair_kernels(name1: pd.Series, name2: pd.Series, sorted1: pd.Series, sorted2: pd.Series, addr1: pd.Series, addr2: pd.Series) -> pd.DataFrame:
    """All kernels of a pair in one crossing to Python; address ones only where both addresses are there."""
    known: dict = {}
    rows = []
    for n1, n2, s1, s2, a1, a2 in zip(name1, name2, sorted1, sorted2, addr1, addr2):
        n = known.get((n1, n2)) or known.setdefault((n1, n2), text_kernels(n1, n2))
        s = known.get((0, s1, s2)) or known.setdefault((0, s1, s2), (jaro_winkler(s1, s2),))
        a = (known.get((1, a1, a2)) or known.setdefault((1, a1, a2), text_kernels(a1, a2))) if a1 and a2 else (0.0, 0.0, 0.0)
        rows.append((*n, *s, *a))
    return pd.DataFrame(rows, columns=KERNELS)


def register(spark) -> None:
    """The kernels by name, for SQL."""
    from . import text as X

    for name, f in (("kw_jaro_winkler", jaro_winkler_sim), ("kw_token_sort", token_sort_sim), ("kw_token_set", token_set_sim)):
        spark.udf.register(name, f)
    for name, f in (("kw_soundex", soundex), ("kw_metaphone", metaphone), ("kw_romanise", X.romanise)):
        spark.udf.register(name, _each(f))


def _each(f):
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        known: dict = {}
        return x.map(lambda v: known[v] if v in known else known.setdefault(v, f(v or "")))

    return run
