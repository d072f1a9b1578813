"""TIFF as a column: one row per page, decoded from the file's bytes, and a writer for lossless storage.

The reader walks the chain of image directories (classic TIFF, either byte order), decodes strips and tiles that are
stored as they are, by PackBits, LZW or deflate, undoes the horizontal and the floating-point predictor, and gives the
samples of each page as bytes in row order, little-endian. The writer stores 8-bit grey pages with any of the codecs.

Defined results: a null file has no pages; a broken file raises in ``pages`` (``BROKEN``) and gives one row with ``error`` in
``explode_pages`` after the pages that could be read; a page of more than ``MOST_BYTES``, or of more than its stored bytes
can hold, is broken, and nothing is allocated for it; a chain of directories that returns to itself ends there. A null
text is stored as an empty one (a payload of one unit); repeated rows and ids give a row, or rows, each; a null id is
carried along; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tag numbers, types' sizes and codec numbers of the TIFF 6.0 format: fixed values.
WIDTH, HEIGHT, BITS, CODEC, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_SIZE, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    codec: int
    data: bytes


#: What reading a broken file may raise.
BROKEN = (ValueError, KeyError, TypeError, IndexError, OverflowError, MemoryError, ArithmeticError, struct.error, zlib.error)
#: The most bytes of a decoded page.
MOST_BYTES = 2**30


def unpackbits(data: bytes, most: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def packbits(row: bytes) -> bytes:
    """One row; rows are packed one by one."""
    out, at = bytearray(), 0
    while at < len(row):
        run = at + 1
        while run < len(row) and run - at < 128 and row[run] == row[at]:
            run += 1
        if run - at > 2:
            out += bytes((257 - (run - at), row[at]))
            at = run
            continue
        end = at
        while end < len(row) and end - at < 128 and not (end + 2 < len(row) and row[end] == row[end + 1] == row[end + 2]):
            end += 1
        out += bytes((end - at - 1,)) + row[at:end]
        at = end
    return bytes(out)


def unlzw(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width grows one code early. Ends at ``most`` bytes."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, width, last = first[:], [], 9, b""
    held = n_held = size = 0
    for byte in data:
        held = held << 8 | byte
        n_held += 8
        if n_held < width:
            continue
        n_held -= width
        code = held >> n_held
        held &= (1 << n_held) - 1
        if code == 256:
            table, width, last = first[:], 9, b""
            continue
        if code == 257:
            break
        if not last:
            if code > 255:
                raise ValueError("LZW: a code that isn't there yet")
            last = table[code]
            out.append(last)
            size += 1
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("LZW: a code that isn't there yet")
        out.append(word)
        size += len(word)
        if most is not None and size >= most:
            break
        table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    out, held, n_held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, n_held
        held = held << width | code
        n_held += width
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held & 255)
        held &= (1 << n_held) - 1

    code_of = lambda w: w[0] if len(w) == 1 else table[w]
    put(256)
    size, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = size
        size += 1
        if size >= 4094:
            put(256)
            table, size, width = {}, 258, 9
        elif size >= (1 << width):
            width += 1
        word = data[i : i + 1]
    if word:
        put(code_of(word))
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    if n_held:
        out.append(held << (8 - n_held) & 255)
    return bytes(out)


#: At most so many bytes come out of one: a deflate code gives 258 bytes for two bits, PackBits 128 for two bytes, an LZW
#: code of 9 bits or more 4,096.
MOST_OUT = {NONE: 1, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64, LZW: 4096}


def _inflate(codec: int, data: bytes, size: int) -> bytes:
    """The first ``size`` bytes, or a few more; a stream that is damaged behind them is damaged."""
    if codec == NONE:
        return data
    if codec in (DEFLATE, OLD_DEFLATE):
        stream = zlib.decompressobj()
        out = stream.decompress(data, size + 1)
        if not stream.eof and len(out) <= size:
            raise ValueError("a deflate stream is cut short")
        return out
    return unpackbits(data, size) if codec == PACKBITS else unlzw(data, size)


def _unpredict(raw: np.ndarray, kind: int, bits: int, samples: int, order: str) -> np.ndarray:
    """``raw``: bytes as (rows, row bytes); the result is little-endian."""
    rows = raw.shape[0]
    if kind == 3:
        size = bits // 8
        flat = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, -1)  # bytes of equal rank together, highest first
        return np.ascontiguousarray(flat.transpose(0, 2, 1)[:, :, ::-1]).reshape(rows, -1)
    if bits < 16:
        values = raw
    else:
        values = raw.view(f"{order}u{bits // 8}").astype(f"<u{bits // 8}")
    if kind == 2:
        if bits < 8:
            raise ValueError("a predictor on samples under 8 bits")
        values = np.cumsum(values.reshape(rows, -1, samples), axis=1, dtype=values.dtype).reshape(rows, -1)
    elif kind != 1:
        raise ValueError(f"predictor {kind}")
    return np.ascontiguousarray(values).view(np.uint8).reshape(rows, -1)


def pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of their directories."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen, index = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            size = struct.calcsize(TYPES[kind]) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if place + size > len(data):
                raise ValueError(f"tag {tag} lies beyond the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place)
        yield _page(data, tags, order, index)
        index += 1
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict, order: str, index: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, codec, kind = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(CODEC, NONE), one(PREDICTOR, 1)
    bits = set(tags.get(BITS, (1,)))
    if not width or not height or len(bits) != 1 or (bits := bits.pop()) not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("a page of a form that isn't read")
    apart = one(PLANAR, 1) == 2 and samples > 1
    planes, each = (samples, 1) if apart else (1, samples)
    if TILE_AT in tags:
        w, h, places, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_AT], tags[TILE_SIZE]
        if bits < 8:
            raise ValueError("tiles of samples under 8 bits")
    else:
        w, h, places = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_AT]
        sizes = tags.get(STRIP_SIZE) or (len(data) - places[0],)
    across, down = -(-width // w), -(-height // h)
    if not len(places) == len(sizes) == across * down * planes:
        raise ValueError("the number of strips or tiles")
    row = (width * each * bits + 7) // 8
    block_row = (w * each * bits + 7) // 8
    if codec not in MOST_OUT:
        raise ValueError(f"codec {codec}")
    if planes * height * row > MOST_BYTES or planes * height * row > sum(min(s, len(data)) + 8 for s in sizes) * MOST_OUT[codec] or h * block_row > MOST_BYTES:
        raise ValueError("a page of more bytes than are stored")
    out = np.zeros((planes, height, row), np.uint8)
    for k, (place, size) in enumerate(zip(places, sizes)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * h, rest % across * w
        rows = h if TILE_AT in tags else min(h, height - y)
        raw = _inflate(codec, data[place : place + size], rows * block_row)
        if len(raw) < rows * block_row or place + size > len(data):
            raise ValueError("a strip or tile is cut short")
        block = _unpredict(np.frombuffer(raw, np.uint8, rows * block_row).reshape(rows, block_row), kind, bits, each, order)
        left = x * each * bits // 8
        take = out[plane, y : y + rows, left : left + block_row]
        take[:] = block[: take.shape[0], : take.shape[1]]
    if apart:
        out = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return Page(index, width, height, samples, bits, codec, np.ascontiguousarray(out).tobytes())


def write_grey(payload: bytes, width: int, rows_per_page: int, codec: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, level: int = 1) -> bytes:
    """8-bit grey pages of ``width`` x up to ``rows_per_page`` that hold ``payload`` (a multiple of width) in order."""
    if not payload or len(payload) % width:
        raise ValueError("the payload is not a positive multiple of the width")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0" + b"\0" * 4)
    link = 4
    for top in range(0, len(image), rows_per_page):
        page = image[top : top + rows_per_page]
        h, w = tile or (min(rows_per_strip, len(page)), width)
        places, sizes = [], []
        for y in range(0, len(page), h):
            for x in range(0, width, w):
                block = page[y : y + h, x : x + w]
                if tile and block.shape != (h, w):
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                raw = np.ascontiguousarray(block).tobytes()
                if codec == PACKBITS:
                    raw = b"".join(packbits(raw[i : i + w]) for i in range(0, len(raw), w))
                else:
                    raw = {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, level)}[codec](raw)
                places.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = [(WIDTH, [width]), (HEIGHT, [len(page)]), (BITS, [8]), (CODEC, [codec]), (PHOTOMETRIC, [1])]
        if tile:
            tags += [(SAMPLES, [1]), (PREDICTOR, [predictor]), (TILE_WIDTH, [w]), (TILE_HEIGHT, [h]), (TILE_AT, places), (TILE_SIZE, sizes)]
        else:
            tags += [(STRIP_AT, places), (SAMPLES, [1]), (ROWS_PER_STRIP, [h]), (STRIP_SIZE, sizes), (PREDICTOR, [predictor])]
        entries = b""
        for tag, values in tags:
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                at = len(out)
                out += raw
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def explode_pages(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, page, width, height, samples, bits, codec, data, error: one row per page."""
    rows = files.select(files[id_col].alias("id"), files[data_col].alias("data"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(x, T.IntegerType()) for x in ("page", "width", "height", "samples", "bits", "codec")), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
    kinds = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("codec", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, i: int, values: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.slice(i, 1), *(pa.array([v], f.type) for v, f in zip(values, kinds))], names=schema.names)

        for batch in batches:
            for i, data in enumerate(batch["data"]):
                if not data.is_valid:
                    continue
                n = 0
                try:
                    for p in pages(data.as_py()):
                        yield out(batch["id"], i, (p.index, p.width, p.height, p.samples, p.bits, p.codec, p.data, None))
                        n += 1
                except BROKEN as e:
                    yield out(batch["id"], i, (n, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))

    return rows.mapInArrow(run, schema)


#: A stored text is a page of 576 columns: the payload's unit.
UNIT, PAGE_ROWS = 576, 1024


def feature(all_pages: list[Page]) -> str:
    """Pages, mean grey level and a 64-bit average hash over 64 bands of columns, summed over all pages (of one width)."""
    total = sum(len(p.data) for p in all_pages)
    columns = sum(np.frombuffer(p.data, np.uint8).reshape(p.height, -1).sum(axis=0, dtype=np.int64) for p in all_pages)
    grey = int(columns.sum())
    fields = columns.reshape(64, -1).sum(axis=1)
    bits = "".join("1" if x > fields.mean() else "0" for x in fields)
    return f"pages={len(all_pages)};mean={grey / total:.3f};hash={int(bits, 2):016x}"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, tiff (the stored file), payload_bytes, payload_sha256, tail_crc32, feature (read back from it)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("tiff", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                cols: list[list] = [[], [], [], [], [], []]
                for text in batch["text"]:
                    data = (text.as_py() or "").encode()
                    size = max(1, -(-len(data) // UNIT)) * UNIT
                    file = write_grey(data + b"\xff" * (size - len(data)), UNIT, PAGE_ROWS)
                    read = list(pages(file))
                    digest, tail, length = hashlib.sha256(), b"", 0
                    for p in read:
                        digest.update(p.data)
                        tail = (tail + p.data[-32:])[-32:]
                        length += len(p.data)
                    for c, v in zip(cols, (len(data), file, length, digest.hexdigest(), zlib.crc32(tail), feature(read))):
                        c.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)
