import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def reference(encoder, text):
    return encoder.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sABé<|>")), max_size=60))
def test_ids_equal_the_tokenizers(encoder, text):
    assert encoder.fast is not None
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference(encoder, text)


def test_other_files_are_run_as_they_are():
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None
    assert np.frombuffer(other.encode("Hello there"), "<u4").tolist() == other.tok.encode("Hello there", add_special_tokens=False).ids


def test_pieces_rebuild_every_document(spark, documents, odd_texts, encoder):
    texts = odd_texts + [f"text number {i} " * (i % 50) for i in range(200)]
    pieces = packing.pack(documents(enumerate(texts)).repartition(3), PATH, window=64).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for i, text in enumerate(texts):
        want = reference(encoder, text or "") + [0]
        ps = sorted(by_doc[i], key=lambda p: p["start"])
        assert np.frombuffer(b"".join(bytes(p["ids"]) for p in ps), "<u4").tolist() == want
        assert [p["start"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))]
        assert {p["doc_tokens"] for p in ps} == {len(want)}
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, ps in by_seq.items():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))]
        assert sum(p["length"] for p in ps) == 64 or s == max(by_seq)


def test_stored_order_is_kept(spark, documents, tmp_path):
    docs = documents([(i, f"doc {i}") for i in range(300)])
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    pieces = packing.pack(spark.read.parquet(str(tmp_path / "d")), PATH, window=32)
    order = [r["doc_id"] for r in pieces.orderBy("sequence_id", "offset").collect()]
    assert [x for i, x in enumerate(order) if i == 0 or order[i - 1] != x] == list(range(300))
    seqs = packing.sequences(pieces)
    assert {r["n_tokens"] for r in seqs.orderBy("sequence_id").collect()[:-1]} == {32}


@pytest.mark.parametrize("unit", [" ", "\n", "x", "\t \n"])
def test_very_long_runs(documents, encoder, unit):
    """tiktoken's pattern gives up on a million blanks; the library does not."""
    text = unit * (1_000_000 // len(unit))
    want = reference(encoder, text) + [0]
    pieces = sorted(packing.pack(documents([(1, text), (2, "b")]), PATH).filter("doc_id = 1").collect(), key=lambda p: p["start"])
    assert np.frombuffer(b"".join(bytes(p["ids"]) for p in pieces), "<u4").tolist() == want


def test_empty_and_extra_columns(spark, documents):
    assert packing.pack(documents([]), PATH).count() == 0
    docs = documents([(None, "x"), (1, None), (1, None)]).selectExpr("doc_id", "text", "1 as run_file", "2 as ids", "3 as sequence_id")
    got = packing.pack(docs, PATH).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == [(False, 1), (False, 1), (True, 2)]
    assert zlib.crc32(bytes(got[-1]["ids"])) is not None
