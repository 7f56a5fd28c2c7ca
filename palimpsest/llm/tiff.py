"""TIFF columns: write and read images whose pages are chained image directories.

The reader walks the directories of either byte order, decodes PackBits, LZW or
deflate strips and tiles, undoes the horizontal predictor and gives one row a
page. The writer makes the same forms. Text columns are stored losslessly: UTF-8
bytes, filled up with zeros, are the samples of grey pages 64 wide. A checksum of
the payload chooses among four forms of storage, so each form meets texts of every
size: LZW strips (one in 16, as they take most work), and in equal parts PackBits
strips, deflate strips and deflate tiles, the last two with the predictor.

Defined cases: null media give no page; a null text is the empty text, whose
payload is one row of zeros; a damaged file gives the pages before the damage and
then a row without pixels that says what is wrong; an empty table gives an empty
result; long texts become several pages; other columns stay, the media column goes,
and one of the output's name is replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

# Fixed values of the format: tag numbers, compression codes, and bytes of the field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMATS = {1: "B", 3: "H", 4: "I"}
CLEAR, END = 256, 257

ROW = 64
#: Rows of a page and of a strip, and the side of a tile.
PAGE_ROWS, STRIP_ROWS = 4096, 256
TILE = 64

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(data: bytes) -> bytes:
    """Runs of three and more become two bytes; the rest literal packets of up to 128."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        at = m.end()
        out += bytes((257 - (at - m.start()), data[m.start()]))
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("run-length data end early")
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, growing one code early as the format wants."""
    bits, filled, out = 0, 0, bytearray()
    width, table = 9, {bytes([i]): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal bits, filled
        bits, filled = bits << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(bits >> filled)
            bits &= (1 << filled) - 1

    put(CLEAR)
    word = b""
    for byte in data:
        grown = word + bytes([byte])
        if grown in table:
            word = grown
            continue
        put(table[word])
        table[grown] = len(table) + 2
        word = grown[-1:]
        if len(table) + 2 == 4095:
            put(CLEAR)
            width, table = 9, {bytes([i]): i for i in range(256)}
        elif len(table) + 2 >= (1 << width):
            width += 1
    if word:
        put(table[word])
        if len(table) + 3 >= (1 << width) and width < 12:
            width += 1
    put(END)
    if filled:
        out.append(bits << (8 - filled) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, bits, filled, at = bytearray(), 0, 0, 0
    width, table, last = 9, [bytes([i]) for i in range(256)] + [b"", b""], b""
    while len(out) < size:
        while filled < width:
            if at >= len(data):
                raise ValueError("LZW data end early")
            bits, filled, at = bits << 8 | data[at], filled + 8, at + 1
        filled -= width
        code, bits = bits >> filled, bits & ((1 << filled) - 1)
        if code == END:
            break
        if code == CLEAR:
            width, table, last = 9, table[:258], b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("a wrong LZW code")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
    return bytes(out[:size])


ENCODE = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1), OLD_DEFLATE: lambda b: zlib.compress(b, 1)}


def decode(kind: int, data: bytes, size: int) -> bytes:
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompress(data)
        except zlib.error as e:
            raise ValueError("damaged deflate data") from e
    elif kind in (NONE, PACKBITS, LZW):
        out = {NONE: lambda b, n: b[:n], PACKBITS: unpackbits, LZW: unlzw}[kind](data, size)
    else:
        raise ValueError(f"unknown compression {kind}")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


class Page(NamedTuple):
    pixels: np.ndarray  # height x width x samples, unsigned 8 or 16 bits
    compression: int = DEFLATE
    predictor: int = 2
    tile: int = 0  # side of square tiles (a multiple of 16), or 0 for strips


def write(pages: list[Page], order: str = "<") -> bytes:
    """A file of the pages, in the byte order "<" or ">"."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        pixels = page.pixels
        height, width, samples = pixels.shape
        bits = pixels.dtype.itemsize * 8
        rows, columns = (page.tile, page.tile) if page.tile else (min(STRIP_ROWS, height), width)
        places, sizes = [], []
        for top in range(0, height, rows):
            for left in range(0, width, columns):
                block = pixels[top : top + rows, left : left + columns]
                if page.tile:
                    block = np.pad(block, ((0, rows - block.shape[0]), (0, columns - block.shape[1]), (0, 0)))
                if page.predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                data = ENCODE[page.compression](block.astype(block.dtype.newbyteorder(order)).tobytes())
                places.append(len(out))
                sizes.append(len(data))
                out += data
        layout = {TILE_WIDTH: (4, [columns]), TILE_HEIGHT: (4, [rows]), TILE_OFFSETS: (4, places), TILE_BYTES: (4, sizes)} if page.tile else {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [rows]), STRIP_BYTES: (4, sizes)}
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [bits] * samples), COMPRESSION: (3, [page.compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [page.predictor])} | layout
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            data = struct.pack(f"{order}{len(values)}{TYPE_FORMATS[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, place = struct.pack(order + "I", len(out)), data
                out += place
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    """The fields of the directory at ``at`` and the place of the next one (0: none)."""
    n = struct.unpack_from(order + "H", data, at)[0]
    fields = {}
    for place in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if letter := TYPE_FORMATS.get(kind):
            size = struct.calcsize("=" + letter) * count
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, start)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read(data: bytes) -> Iterator[np.ndarray]:
    """The pixels of each page, as height x width x samples."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF")
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            fields, at = _fields(data, order, at)
            yield _pixels(data, order, fields)
    except (KeyError, IndexError, ZeroDivisionError, MemoryError, struct.error, zlib.error) as e:
        raise ValueError("not a TIFF, or a damaged one") from e


def _pixels(data: bytes, order: str, fields: dict[int, tuple[int, ...]]) -> np.ndarray:
    width, height, samples = fields[WIDTH][0], fields[HEIGHT][0], fields.get(SAMPLES, (1,))[0]
    bits = set(fields.get(BITS, (1,)))
    if bits not in ({8}, {16}) or fields.get(PLANAR, (1,))[0] != 1:
        raise ValueError("only interleaved samples of 8 or 16 bits can be read")
    kind = np.dtype(f"{order}u{bits.pop() // 8}")
    tiled = TILE_OFFSETS in fields
    columns, rows = (fields[TILE_WIDTH][0], fields[TILE_HEIGHT][0]) if tiled else (width, min(height, fields.get(ROWS_PER_STRIP, (height,))[0]))
    places, sizes = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    compression, predictor = fields.get(COMPRESSION, (1,))[0], fields.get(PREDICTOR, (1,))[0]
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    across = -(-width // columns)
    for k in range(across * -(-height // rows)):
        top, left = k // across * rows, k % across * columns
        tall = rows if tiled else min(rows, height - top)
        raw = decode(compression, data[places[k] : places[k] + sizes[k]], tall * columns * samples * kind.itemsize)
        block = np.frombuffer(raw, kind).reshape(tall, columns, samples).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[top : top + tall, left : left + columns] = block[: height - top, : width - left]
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes and their number without padding."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0"), len(raw)


def form_of(payload: bytes) -> tuple[int, int, int]:
    """Compression, predictor and tile side that a payload is stored with."""
    k = zlib.crc32(payload) % 16
    return (LZW, 1, 0) if k == 0 else (PACKBITS, 1, 0) if k <= 5 else (DEFLATE, 2, 0) if k <= 10 else (DEFLATE, 2, TILE)


def to_tiff(payload: bytes) -> bytes:
    """Store a payload as grey pages."""
    samples, form = np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1), form_of(payload)
    return write([Page(samples[top : top + PAGE_ROWS], *form) for top in range(0, len(samples), PAGE_ROWS)])


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, pixels binary, error string"


def pages(df: DataFrame, media: str) -> DataFrame:
    """One row a page: the other columns of ``df`` and a struct ``tiff_page`` (PAGE_FIELDS); ``error`` is null but for the place where a file is damaged."""

    def rows(data: bytes | None) -> Iterator[dict]:
        k = -1
        try:
            for k, p in enumerate(read(data) if data is not None else ()):
                yield {"page": k, "width": p.shape[1], "height": p.shape[0], "samples": p.shape[2], "bits": 8 * p.itemsize, "pixels": p.tobytes(), "error": None}
        except ValueError as e:
            yield {"page": k + 1, "error": str(e)}

    @F.pandas_udf(f"array<struct<{PAGE_FIELDS}>>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(rows(m)) for m in s], dtype=object)

    return bounded(df).withColumn("tiff_page", F.explode(walk(F.col(media)))).drop(media)


def describe(pages: list[np.ndarray]) -> str:
    """Features of the decoded samples: pages, rows, mean, deviation, entropy in bits, share of zeros."""
    counts = sum((np.bincount(p.reshape(-1), minlength=256) for p in pages), np.zeros(256, np.int64))
    n, values = counts.sum(), np.arange(256)
    mean = (counts * values).sum() / n
    share = counts[counts > 0] / n
    return f"pages={len(pages)};rows={sum(map(len, pages))};mean={mean:.4f};sd={np.sqrt(max(0.0, (counts * values**2).sum() / n - mean**2)):.4f};entropy={-(share * np.log2(share)).sum():.4f};zeros={counts[0] / n:.4f}"


MEDIA_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(text: str | None) -> tuple:
    """Write a text as TIFF, read it back and describe what was read."""
    payload, n = payload_of(text)
    media = to_tiff(payload)
    found = list(read(media))
    back = b"".join(p.tobytes() for p in found)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), describe(found)


def media_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and MEDIA_FIELDS."""

    @F.pandas_udf(MEDIA_FIELDS)
    def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in MEDIA_FIELDS.split(", ")]
        for s in batches:
            yield pd.DataFrame([stored(t) for t in s], columns=names)

    return bounded(docs).select("doc_id", report(F.col("text")).alias("m")).select("doc_id", "m.*")
