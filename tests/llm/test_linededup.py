import hashlib
import time

import pytest

from kinweave.llm import linededup, registry

WS = " \t\n\v\f\r"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(texts, min_docs, min_chars, keep):
    docs = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(WS).translate(LOWER)
    seen, first = {}, {}
    for i, d in enumerate(docs):
        for p, x in enumerate(d):
            if len(key(x)) >= min_chars:
                seen.setdefault(key(x), set()).add(i)
                first.setdefault(key(x), (i, p))
    out = {}
    for i, d in enumerate(docs):
        gone = [p for p, x in enumerate(d) if len(seen.get(key(x), ())) >= min_docs and not (keep == "first" and first[key(x)] == (i, p))]
        out[i] = ("\n".join(x for p, x in enumerate(d) if p not in gone), len(d), len(gone))
    return out


@pytest.mark.parametrize("min_docs,min_chars,keep", [(2, 1, "first"), (3, 1, "none"), (2, 5, "none"), (1, 1, "first")])
def test_against_brute_force(documents, odd_texts, min_docs, min_chars, keep):
    texts = odd_texts[:11] + ["İ\nI\ni", "É\né", " shared\nown 1", "SHARED \nown 2\nshared", "x\n shared\t\ny"] + [f"common\nrow {i}\n\nCommon " for i in range(40)]
    got = linededup.apply(documents(enumerate(texts)).repartition(3), min_docs=min_docs, min_chars=min_chars, keep=keep).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got} == brute(texts, min_docs, min_chars, keep)


def test_bitmaps_of_runs(documents):
    texts = ["a\nb\nc\na\nown\nown 2\na", "b\nx", "c", "a\nb", "alone"]
    end = linededup.TO_THE_END
    got = {r["id"]: (r["n_dropped"], [tuple(x) for x in r["keep_runs"]]) for r in linededup.keep_bitmaps(documents(enumerate(texts)), min_docs=2, keep="none").collect()}
    assert got == {0: (5, [(4, 2), (7, end)]), 1: (1, [(1, end)]), 2: (1, [(1, end)]), 3: (2, [(2, end)])}


def test_a_text_of_very_many_runs(documents):
    """Each run costs its own lines, not another split of the text."""
    long = "\n".join(f"own {i}\nshared" for i in range(100_000))
    began = time.time()
    got = {r["doc_id"]: r for r in linededup.apply(documents([(1, long), (2, "shared"), (3, "\n" * 1_000_000), (4, "x" * 1_000_000)]), min_docs=2, keep="none").collect()}
    assert time.time() - began < 60
    assert got[1]["text"] == long.replace("\nshared", "") and got[1]["n_dropped"] == 100_000
    assert got[3]["n_lines"] == 1_000_001 and got[3]["text"] == "\n" * 1_000_000 and got[4]["text"] == "x" * 1_000_000


def test_repeated_rows_null_ids_and_clashing_names(spark, documents):
    docs = documents([(1, "a\nb"), (1, "a\nb"), (None, "a"), (None, "z"), (1, "q")]).selectExpr("*", "7 as n_lines", "8 as kw_dropped", "9 as id")
    got = linededup.apply(docs, min_docs=2, keep="none").collect()
    assert sorted(((r["doc_id"] or 0), r["text"], r["n_lines"], r["n_lines_"], r["id"]) for r in got) == [(0, "", 7, 1, 9), (0, "z", 7, 1, 9), (1, "b", 7, 2, 9), (1, "b", 7, 2, 9), (1, "q", 7, 1, 9)]
    assert linededup.apply(documents([])).count() == 0


def test_query_against_sql(spark, duck, same):
    same(spark, duck, registry.op2_line_dedup, registry.ORACLE_SQL["op2_line_dedup"])


def test_the_digest_is_of_the_text(documents):
    r = linededup.apply(documents([(1, "a")]), min_docs=2).first()
    assert hashlib.sha256(r["text"].encode()).hexdigest() == hashlib.sha256(b"a").hexdigest()


def test_no_python_in_the_plan(documents):
    plan = linededup.apply(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
