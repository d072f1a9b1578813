"""Other scripts in Latin letters: a table of sounds by code point, and the column expression that looks them up."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sounds of Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j",
    "љ": "lj", "њ": "nj", "ћ": "c", "ќ": "kj", "ў": "u", "џ": "dz", "ґ": "g", "ё": "io",
}
# Sounds of Greek letters.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
# Sounds of Hebrew letters.
HEBREW = {
    "א": "", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "ך": "k", "כ": "k", "ל": "l",
    "ם": "m", "מ": "m", "ן": "n", "נ": "n", "ס": "s", "ע": "", "ף": "p", "פ": "p", "ץ": "ts", "צ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t",
}
# Sounds of Arabic letters, those of Persian and Urdu included.
ARABIC = {
    "ء": "", "آ": "a", "أ": "a", "ؤ": "u", "إ": "i", "ئ": "i", "ا": "a", "ب": "b", "ة": "h", "ت": "t", "ث": "th", "ج": "j", "ح": "h",
    "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "gh",
    "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ى": "a", "ي": "y", "ٹ": "tt", "پ": "p", "چ": "ch",
    "ڈ": "dd", "ڑ": "rr", "ژ": "zh", "ک": "k", "گ": "g", "ں": "n", "ہ": "h", "ھ": "h", "ی": "y", "ے": "e",
}
# Kana whose usual spelling is not their Unicode name, and the parts of a Hangul syllable in their order.
KANA = {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu", "ヲ": "o", "ン": "n", "ッ": "", "ー": ""}
HANGUL_FIRST = ["g", "gg", "n", "d", "dd", "r", "m", "b", "bb", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
HANGUL_VOWEL = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "weo", "we", "wi", "yu", "eu", "yi", "i"]
HANGUL_LAST = ["", "g", "gg", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "c", "k", "t", "p", "h"]
# Sounds of Thai consonants in the order of their code points from U+0E01, and of the vowels from U+0E30.
THAI_CONSONANTS = ["k", "kh", "kh", "kh", "kh", "kh", "ng", "ch", "ch", "ch", "s", "ch", "y", "d", "t", "th", "th", "th", "n", "d", "t", "th", "th", "th", "n", "b", "p", "ph", "f", "ph", "f", "ph", "m", "y", "r", "rue", "l", "lue", "w", "s", "s", "s", "h", "l", "o", "h"]
THAI_VOWELS = ["a", "a", "a", "am", "i", "i", "ue", "ue", "u", "u"]
THAI_LEADING = {"เ": "e", "แ": "ae", "โ": "o", "ใ": "ai", "ไ": "ai", "ๅ": "a"}

#: Blocks that are looked up: combining marks and Greek to Thai, letter-like signs, kana, ligatures and presentation forms,
#: full-width forms.
BLOCKS = ((0x300, 0xE5F), (0x2100, 0x214F), (0x3040, 0x30FF), (0xFB00, 0xFEFC), (0xFF00, 0xFF5E))
HANGUL = (0xAC00, 0xD7A3)


@functools.cache
def _letters() -> dict[str, str]:
    out = CYRILLIC | GREEK | HEBREW | ARABIC | THAI_LEADING
    out |= {chr(0xE01 + i): x for i, x in enumerate(THAI_CONSONANTS)} | {chr(0xE30 + i): x for i, x in enumerate(THAI_VOWELS)}
    return out | {x.upper(): s for x, s in out.items() if x.upper() != x and len(x.upper()) == 1}


def sound(c: str) -> str:
    """What stands for a character: its sound, an ASCII decomposition, nothing for a mark, and itself where nothing is known.

    Indic consonants lose the inherent vowel, so a virama needs no context; vowels and vowel signs spell themselves; nasal
    marks are N, a visarga is H. Unicode names these letters, and kana, by their sounds.
    """
    if c.isascii() or not c.strip():
        return c
    letters = _letters()
    if c in letters:
        return letters[c]
    cp = ord(c)
    if HANGUL[0] <= cp <= HANGUL[1]:
        n = cp - HANGUL[0]
        return HANGUL_FIRST[n // 588] + HANGUL_VOWEL[n % 588 // 28] + HANGUL_LAST[n % 28]
    name = unicodedata.name(c, "")
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if name.startswith(("HIRAGANA LETTER ", "KATAKANA LETTER ", "KATAKANA-HIRAGANA ")):
        kana = chr(cp + 0x60) if cp < 0x30A0 else c
        return KANA.get(kana, name.split(" LETTER ")[-1].split()[-1].lower())
    base = unicodedata.normalize("NFKD", c)
    if base[0].isascii() and base != c:
        return "".join(x for x in base if x.isascii())
    if base[0] != c and base[0] in letters:
        return "".join(letters.get(x, "") for x in base)
    if " VOWEL SIGN " in name:
        return name.rsplit(" VOWEL SIGN ")[1].split()[-1].lower()
    if 0x900 <= cp < 0xE00 and " LETTER " in name:
        spelled = name.split(" LETTER ")[1].split()[-1].lower()
        return spelled if all(x in "aeiou" for x in spelled) else spelled.removesuffix("a")
    if "ANUSVARA" in name or "CANDRABINDU" in name or "TIPPI" in name or "BINDI" in name:
        return "N"
    if "VISARGA" in name:
        return "H"
    return "" if unicodedata.category(c).startswith("M") or "VIRAMA" in name else c


@functools.cache
def _table(lo: int, hi: int) -> str:
    return "|".join(sound(chr(cp)).replace("|", "") if unicodedata.category(chr(cp)) != "Cn" else "" for cp in range(lo, hi + 1))


def romanised(x: Column) -> Column:
    """Each character of the blocks by its sound, in the JVM; others (Han, for one) as they are."""

    def of(c: Column) -> Column:
        cp = F.ascii(c)
        n = cp - HANGUL[0]
        part = lambda table, i: F.get(F.split(F.lit("|".join(table)), r"\|", -1), i.cast("int"))
        out = F.when(cp < 0x80, c)
        for lo, hi in BLOCKS:
            out = out.when(cp.between(lo, hi), F.get(F.split(F.lit(_table(lo, hi)), r"\|", -1), cp - lo))
        syllable = F.concat(part(HANGUL_FIRST, F.floor(n / 588)), part(HANGUL_VOWEL, F.floor(n % 588 / 28)), part(HANGUL_LAST, n % 28))
        return out.when(cp.between(*HANGUL), syllable).otherwise(c)

    return F.array_join(F.transform(F.split(x, ""), of), "")
