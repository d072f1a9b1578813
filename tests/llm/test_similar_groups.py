import random

from kinweave.llm import simhash


def jaccard(a, b, words=5):
    x, y = (set(simhash.shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_copies_meet_and_others_do_not(documents):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts, source = [], []
    for g in range(30):
        original = [word() for _ in range(rng.randint(120, 400))]
        texts.append(" ".join(original))
        source.append(g)
        for _ in range(rng.randint(0, 6)):
            copy = list(original)
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            source.append(g)
    passage = " ".join(word() for _ in range(60))  # in many documents, which stay apart
    for g in range(30, 60):
        texts.append(passage + " " + " ".join(word() for _ in range(200)))
        source.append(g)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(enumerate(texts)).repartition(3)).collect()}
    for i in range(len(texts)):
        for j in range(i):
            if source[i] != source[j]:
                assert got[i] != got[j]
            elif jaccard(texts[i], texts[j]) >= 0.85:
                assert got[i] == got[j] == source.index(source[i])


def test_equal_words_and_empty_texts(documents):
    docs = documents([(3, "One two"), (1, "one  two\n"), (2, None), (5, ""), (4, " \n"), (6, "three")])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 5: 2, 4: 2, 6: 6}
    assert simhash.similar_groups(documents([])).count() == 0


def test_a_chain_of_versions_is_one_group(documents):
    words = [f"w{i}" for i in range(304 + 20 * 60)]
    texts = [" ".join(words[20 * v : 20 * v + 304]) for v in range(61)]  # 300 shingles, neighbours share 280 of 320
    assert 0.87 < jaccard(*texts[:2]) < 0.88 and jaccard(texts[0], texts[2]) < 0.78
    texts += [" ".join(words[: 300 + i] + [f"x{i}_{j}" for j in range(40)]) for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(enumerate(texts))).collect()}
    assert {got[i] for i in range(61)} == {0}


def test_the_threshold_is_that_of_the_shingles(documents):
    rng = random.Random(9)
    texts = []
    for n in [4, 5] * 20:  # words changed at the end: of 100 shingles, similarities 96 / 104 and so on
        words = [f"{rng.getrandbits(40):x}" for _ in range(104)]
        texts += [" ".join(words), " ".join(words[: 104 - n * 2 - 3] + [f"{rng.getrandbits(40):x}" for _ in range(n * 2 + 3)])]
    true = [jaccard(*texts[i : i + 2]) for i in range(0, len(texts), 2)]
    assert min(true) < 0.79 and max(true) > 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(enumerate(texts))).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(true))] == [x >= 0.8 for x in true]
