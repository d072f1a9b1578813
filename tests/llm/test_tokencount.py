import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    lengths = tokencount.Lengths([" a", " the", " unbelievable", " 中文"], MODEL)
    return tokencount.Counter(MODEL, lengths.table(), cache_bytes=20_000)


def test_the_vocabulary_allows_words(counter):
    assert counter.by_word


def test_tier_one_is_the_frequent_words_of_the_corpus(documents, counter):
    words = tokencount.frequent_words(documents([(i, "rare%d often  twice twice\noften %s" % (i, "x" * 100)) for i in range(30)] + [(99, None)]), words=2)
    assert words == [" often", " twice"]
    table = tokencount.Lengths(words, MODEL).table()
    assert table == {w: len(counter.sp.encode(w[1:])) for w in words}
    assert tokencount.Lengths([], MODEL).table() == {}


def test_the_cache_is_bounded_in_bytes(counter):
    before = tokencount.Counter(MODEL, {}, cache_bytes=10**6)
    for i in range(20):
        before.count("y" * 20_000 + str(i))
    assert before.held < 500  # long words aren't kept
    text = " ".join(f"w{i}" for i in range(30_000))
    assert before.count(text) == len(before.sp.encode(text))
    for i in range(200):
        before.count(" ".join(f"{i}-{j}" for j in range(100)))
    assert before.held <= 10**6 + 100 * 200 and sum(len(w) + tokencount.ENTRY_BYTES for w in before.known) == before.held


@pytest.mark.parametrize("unit", [" ", "\n", "x"])
def test_very_long_texts(counter, unit):
    text = unit * 300_000 + " end"
    assert counter.count(text) == len(counter.sp.encode(text))


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁\tabé<s>/")), max_size=80))
def test_counts_equal_the_models(counter, text):
    assert counter.count(text) == len(counter.sp.encode(text))


def test_table(documents, odd_texts, counter):
    got = {r["doc_id"]: r for r in tokencount.count_tokens(documents(enumerate(odd_texts)), MODEL, limit=100).collect()}
    for i, t in enumerate(odd_texts):
        n = len(counter.sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert tokencount.count_tokens(documents([]), MODEL).count() == 0
