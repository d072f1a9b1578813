import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions.scripts import BLOCKS, HANGUL
from kinweave.functions import text as X
from kinweave.operators.represent import represent
from kinweave.sources.records import RECORD


def records(spark, *rows):
    return spark.createDataFrame([(f"S{1 + bool(i)}-{i:03d}", *r, *[None] * (3 - len(r))) for i, r in enumerate(rows)], RECORD)


def rep(spark, name=None, address=None, country=None, scripts="all"):
    return represent(records(spark, (name, address, country)), scripts).first()


@pytest.mark.parametrize("name,clean,compressed", [
    ("Acme Corporation & Co.", "acme corp and co", "acmecorpandco"),
    ("Acme Corp and Company", "acme corp and co", "acmecorpandco"),
    ("Reliance Industries Private Limited", "reliance ind pvt ltd", "relianceindpvtltd"),
    ("maurewilliamscolombier.com", "maurewilliamscolombier", "maurewilliamscolombier"),
    ("Société Générale GmbH", "soc generale gmbh", "socgeneralegmbh"),
    (None, "", ""), ("", "", ""), ("!!!", "", ""),
])
def test_names(spark, name, clean, compressed):
    r = rep(spark, name)
    assert (r["name_clean"], r["compressed"]) == (clean, compressed)


def test_acronyms(spark):
    assert rep(spark, "International Business Machines")["acronym"] == "ibm"
    assert rep(spark, "International Business Machines Corp")["acronym"] == "ibm"
    assert rep(spark, "The Company")["acronym"] == "tc"  # nothing telling: all initials


def test_addresses(spark):
    r = rep(spark, None, "123 Main Street, Suite 400, Rd 5")
    assert r["street_no"] == "123" and {"st", "rd"} <= set(r["addr_tokens"])
    r = rep(spark, None, "Near SBI ATM, MG Road, Bangalore 560001")
    assert (r["landmark"], r["postal"], r["street_no"]) == ("sbi atm", "560001", None)
    assert rep(spark, None, "12 Rue, 560 001 X")["postal"] == "560001"
    assert rep(spark, None, "10504-1234 A")["postal"] == "105041234"
    assert rep(spark, None, "12345 Main St 560001")["postal"] == "12345"  # the leftmost one
    r = rep(spark)
    assert (r["addr_clean"], r["postal"], r["landmark"]) == ("", None, None)


def test_countries(spark):
    got = [rep(spark, None, None, c)["country"] for c in ("US", " usa", "U.S.", "India", "IND", "France", "FR", "FRA", "france", "Germany", "Spain", None)]
    assert got == ["US", "US", "US", "INDIA", "INDIA", "FRANCE", "FRANCE", "FRANCE", "FRANCE", "GERMANY", "SPAIN", ""]


def test_scripts(spark):
    assert X.romanise("प्राइवेट लिमिटेड") == "praaivett limittedd"
    assert rep(spark, "टाटा प्राइवेट लिमिटेड", scripts="all")["name_clean"].endswith("pvt ltd")
    assert X.romanise("Straße Œuvre ३") == "Strasse OEuvre 3"
    assert rep(spark, "ŠKODA Łódź ﬁ", scripts="all")["name_clean"] == "skoda lodz fi"


@pytest.mark.parametrize("text,latin", [
    ("Москва Щукин Ёлка объём", "Moskva Shchukin Iolka obiom"), ("Ελλάδα Αθήνα ψωμί", "Ellada Athena psomi"), ("شركة النور", "shrkh alnwr"), ("חברת שלום", "khbrt shlvm"),
    ("カタカナ トヨタ ひらがな シチツ", "katakana toyota hiragana shichitsu"), ("서울 한국 빛", "seoul hangug bic"), ("กรุงเทพ", "krungethph"), ("ＡＢＣ １２", "ABC 12"), ("e\u0301te\u0301", "ete"), ("中文 ok", "中文 ok"),
])
def test_sounds_of_scripts(spark, text, latin):
    one = spark.createDataFrame([(text,)], "x string").select(X.transliterate(F.col("x"))).first()[0]
    assert one.lower() == latin.lower() == X.romanise(text).lower()
    assert rep(spark, text, scripts="all")["name_clean"] == " ".join(latin.lower().split())


def test_every_letter_of_the_blocks(spark):
    chars = [chr(cp) for lo, hi in (*BLOCKS, HANGUL) for cp in range(lo, hi + 1, 1 if hi < 0xAC00 else 37) if unicodedata.category(chr(cp)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in chars], "x string")
    got = df.select("x", X.romanised(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == {c: X.romanise(c) for c in chars}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abcdefghijklmnopqrstuvwxyz -3É", max_size=14) | st.from_regex("[ckgstpdaeiouhnwrxyz]{1,10}", fullmatch=True), min_size=60, max_size=60))
def test_sounds_against_python(spark, words):
    df = spark.createDataFrame([(w,) for w in [*words, None, "", "Tymczak", "knight", "gnu", "scho", "sion", "tia"]], "w string")
    for r in df.select("w", S.soundex_code("w").alias("s"), S.metaphone_code("w").alias("m"), S.metaphone_codes(F.array("w", F.lit("phone"))).alias("ms"), S.soundex_codes(F.array("w")).alias("ss")).collect():
        assert (r["s"], r["m"]) == (S.soundex(r["w"] or ""), S.metaphone(r["w"] or ""))
        assert r["ms"] == [r["m"], "FN"] and r["ss"] == [r["s"]]


def plain_jaro(a, b):
    """By two loops."""
    reach, taken, common = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            common.append(c)
    if not common:
        return 0.0
    m = len(common)
    moved = sum(x != b[j] for x, j in zip(common, sorted(taken))) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@settings(max_examples=500, deadline=None)
@given(st.text("abcd", min_size=1, max_size=90), st.text("abcd", min_size=1, max_size=90))
def test_jaro_against_loops(a, b):
    assert S.jaro(a, b) == pytest.approx(1.0 if a == b else plain_jaro(a, b), abs=1e-12)


def test_domains_ids_and_plots(spark):
    df = spark.createDataFrame([("**http://www.Shop-One.co.in/x",), ("acme com",), (None,)], "x string")
    assert [r[0] for r in df.select(X.strip_domain(F.col("x"))).collect()] == ["shop-one/x", "acme ", ""]
    ids = spark.createDataFrame([("",), ("   ",), ("S2-001, S3-002,",), ("a,a",), (None,)], "x string")
    assert [r[0] for r in ids.select(X.id_list(F.col("x"))).collect()] == [[], [], ["S2-001", "S3-002"], ["a"], []]
    plots = spark.createDataFrame([("Plot 12/A near",), ("Shop-7",), ("xyz",)], "x string")
    assert [r[0] for r in plots.select(X.plot_number(F.col("x"))).collect()] == ["12/A", "7", None]


def test_ngrams(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcabc",)], "x string")
    assert [sorted(r[0]) for r in df.select(X.char_ngrams(F.col("x"))).collect()] == [[], ["ab"], ["abc", "bca", "cab"]]


def test_pinned_vectors():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("", "") == 1.0 and S.jaro_winkler("a", "") == 0.0 and S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.indel("", "") == 1.0 and S.indel("this is a test", "this is a test!") == pytest.approx(2 * 14 / 29)
    assert S.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1.0
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0 and S.token_set("", "a") == 0.0
    assert [S.soundex(w) for w in ("Tymczak", "Robert", "Rupert", "123", "", "Ashcraft")] == ["T520", "R163", "R163", "", "", "A261"]
    assert [S.metaphone(w) for w in ("phone", "church", "thumb", "xray", "edge", "123")] == ["FN", "XRX", "0MB", "KSR", "EK", ""]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs_against_a_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert S.lcs(a, b) == t[-1][-1]
    assert 0 <= S.jaro_winkler(a, b) <= 1 and S.jaro_winkler(a, b) == pytest.approx(S.jaro_winkler(b, a), abs=0.2)


def test_kernels_in_sql(spark):
    S.register(spark)
    r = spark.sql("select kw_soundex('Tymczak') s, kw_metaphone('phone') m, kw_jaro_winkler('martha', 'marhta') j, kw_token_sort('a b', 'b a') t, kw_token_set('a b', 'b a c') u").first()
    assert (r["s"], r["m"], round(r["j"], 5), r["t"], r["u"]) == ("T520", "FN", 0.96111, 1.0, 1.0)


def test_phonetic_ratio(spark):
    rows = [(["NFT", ""], ["NFT", "X", "Y"]), (["A", "B"], ["B", "C"]), ([], ["A"]), ([""], [""])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.phonetic_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.5, 0.0, 0.0]
