import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import tiff

CODECS = [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600) | st.lists(st.tuples(st.binary(min_size=1, max_size=3), st.integers(1, 300)), max_size=8).map(lambda r: b"".join(a * n for a, n in r)))
def test_codecs_round_trip(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_over_many_widths():
    data = np.random.default_rng(0).integers(0, 7, 60_000).astype(np.uint8).tobytes() + bytes(range(256)) * 40
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_known_codes():
    assert tiff.unpackbits(bytes.fromhex("feaa0280002afdaa0380002a22f7aa")) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    assert tiff.unlzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_files_round_trip(codec, predictor, tile):
    payload = np.random.default_rng(1).integers(0, 40, 100 * 70).astype(np.uint8).tobytes()
    file = tiff.write_grey(payload, 100, 32, codec, predictor, 9, tile)
    pages = list(tiff.pages(file))
    assert [(p.width, p.height) for p in pages] == [(100, 32), (100, 32), (100, 6)]
    assert b"".join(p.data for p in pages) == payload


def built(order, tags, body=b""):
    """A one-page file: tags {tag: (type, values)}, strips at 8."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0) + body)
    entries = b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values)
        if len(raw) > 4:
            at = len(out)
            out += raw
            raw = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0")


@pytest.mark.parametrize("order", ["<", ">"])
def test_wide_samples_planes_and_predictors(order):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 60_000, (4, 5, 3)).astype("<u2")
    diff = rgb.astype(f"{order}u2").copy()
    diff[:, 1:] -= rgb[:, :-1].astype(f"{order}u2")
    body = zlib.compress(diff.astype(f"{order}u2").tobytes())
    base = {256: (3, [5]), 257: (3, [4]), 258: (3, [16] * 3), 259: (3, [8]), 262: (3, [2]), 273: (4, [8]), 277: (3, [3]), 279: (4, [len(body)]), 317: (3, [2])}
    assert next(tiff.pages(built(order, base, body))).data == rgb.tobytes()
    planes = rgb.transpose(2, 0, 1).astype(f"{order}u2").tobytes()
    apart = base | {259: (3, [1]), 317: (3, [1]), 284: (3, [2]), 273: (4, [8, 48, 88]), 279: (4, [40] * 3)}
    assert next(tiff.pages(built(order, apart, planes))).data == rgb.tobytes()
    x = rng.normal(size=(3, 6)).astype("<f4")
    by_rank = x.view(np.uint8).reshape(3, 6, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(3, 24)
    coded = np.diff(by_rank, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    floats = {256: (3, [6]), 257: (3, [3]), 258: (3, [32]), 259: (3, [1]), 273: (4, [8]), 279: (4, [72]), 317: (3, [3]), 339: (3, [3])}
    assert next(tiff.pages(built(order, floats, coded))).data == x.tobytes()
    bits = {256: (3, [12]), 257: (3, [2]), 258: (3, [1]), 259: (3, [1]), 273: (4, [8]), 279: (4, [4])}
    assert next(tiff.pages(built(order, bits, b"\xaa\xb0\x55\x40"))).data == b"\xaa\xb0\x55\x40"


def test_rows_per_page_and_errors(spark):
    good = tiff.write_grey(bytes(64 * 10), 64, 4)
    looped = bytearray(good)
    df = spark.createDataFrame([(1, good), (2, b"nonsense"), (3, None), (4, bytes(looped[:60])), (None, good)], "id long, f binary").selectExpr("*", "1 as page", "2 as data")
    got = tiff.explode_pages(df, "id", "f").collect()
    assert sorted((r["page"], r["height"]) for r in got if r["id"] == 1) == [(0, 4), (1, 4), (2, 2)]
    assert [r["error"] is not None for r in got if r["id"] in (2, 4)] == [True, True] and not [r for r in got if r["id"] == 3]


def test_damaged_files_never_end_a_task():
    """Any byte of a file changed, or the file cut: pages or one of the errors that are caught, and no large allocation."""
    rng = np.random.default_rng(5)
    payload = rng.integers(0, 9, 64 * 20).astype(np.uint8).tobytes()
    broken = 0
    for codec in CODECS:
        for tile in (None, (16, 16)):
            file = tiff.write_grey(payload, 64, 10, codec, 2, 4, tile)
            damaged = [file[:at] for at in range(0, len(file), 7)]
            for at in [*range(16), *rng.integers(0, len(file), 400).tolist(), *range(len(file) - 150, len(file))]:
                for value in (0, 255, int(rng.integers(256))):
                    damaged.append(file[:at] + bytes((value,)) + file[at + 1 :])
            for x in damaged:
                try:
                    assert sum(len(p.data) for p in tiff.pages(x)) < 10**8
                except tiff.BROKEN:
                    broken += 1
    assert broken > 1000


def test_a_claim_of_a_huge_page_is_refused(spark):
    body = zlib.compress(bytes(100))
    tags = {256: (4, [4_000_000_000]), 257: (4, [4_000_000_000]), 258: (3, [8]), 259: (3, [8]), 273: (4, [8]), 279: (4, [len(body)])}
    bomb = zlib.compress(bytes(10**7), 9)
    more = {256: (4, [10]), 257: (4, [10]), 258: (3, [8]), 259: (3, [8]), 273: (4, [8]), 279: (4, [len(bomb)])}
    lzw = built("<", more | {259: (3, [5])}, bytes([0x80, 0x7F, 0xFF, 0xFF, 0xFF]))
    df = spark.createDataFrame([(1, built("<", tags, body)), (2, built(">", more, bomb)), (3, lzw)], "id long, f binary")
    got = {r["id"]: r for r in tiff.explode_pages(df, "id", "f").collect()}
    assert got[1]["error"] and got[1]["data"] is None and got[3]["error"]
    assert bytes(got[2]["data"]) == bytes(100)


def test_texts_are_stored_without_loss(documents, odd_texts):
    got = {r["doc_id"]: r for r in tiff.stored_texts(documents(enumerate(odd_texts))).collect()}
    for i, t in enumerate(odd_texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert b"".join(p.data for p in tiff.pages(bytes(r["tiff"]))) == payload
    assert got[11]["feature"] == got[12]["feature"] and bytes(got[11]["tiff"]) == bytes(got[12]["tiff"])
    assert tiff.stored_texts(documents([])).count() == 0


def test_the_feature_covers_all_pages():
    rows = np.random.default_rng(3).integers(0, 256, (3 * tiff.PAGE_ROWS, tiff.UNIT)).astype(np.uint8)
    other = rows.copy()
    other[tiff.PAGE_ROWS :] = other[tiff.PAGE_ROWS :, ::-1]  # the first page and the mean are the same
    a, b = (tiff.feature(list(tiff.pages(tiff.write_grey(x.tobytes(), tiff.UNIT, tiff.PAGE_ROWS)))) for x in (rows, other))
    assert a.split(";")[:2] == b.split(";")[:2] and a.split(";")[2] != b.split(";")[2]
