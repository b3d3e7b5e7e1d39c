"""Operator 10: media columns, TIFF.

:func:`tiff_pages` walks the image directories of every file in a binary column
and gives a row per page, with its samples decoded: strips or tiles, without
compression or in PackBits, LZW or deflate, with predictors 1 (none),
2 (horizontal differences, 8 to 64 bits) and 3 (floating point), in either byte
order, chunky or planar, in either bit order of bytes. Samples of fewer than 8 bits
stay packed. Another predictor or bit order, samples of unlike bits and predictors on
samples that aren't whole bytes are errors.
:func:`encode_pages` writes what the reader reads; :func:`store_text` uses it to keep
texts as 8-bit samples, in a codec and layout that a checksum of the text chooses.

Edge cases: null or empty content gives no page; a page that can't be decoded, one
whose strips end early or lie beyond the file among them, is a row with ``error``
and no samples, and the pages behind it follow; a broken directory gives such a row
and ends the walk; directories that loop end it too; an empty table gives no row.
Other columns of files pass through, whatever their names and types. Rows are
independent, so repeated and very long ones need no care beyond the memory of one
file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import scan

BLOCK = 576  # a payload is a multiple of this, and an image row has as many samples
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
# Fixed values of the file format: tags, and field types with their sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FILL_ORDER = 266
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, END, FIRST = 256, 257, 258

PAGE_FIELDS = (
    ("page", "int", pa.int32()),
    ("width", "long", pa.int64()),
    ("height", "long", pa.int64()),
    ("samples_per_pixel", "int", pa.int32()),
    ("bits", "int", pa.int32()),
    ("compression", "int", pa.int32()),
    ("predictor", "int", pa.int32()),
    ("samples", "binary", pa.binary()),
    ("error", "string", pa.string()),
)
STRIP = 32  # rows of a strip of a text's image
TILE, TILED_WIDTH = (16, 96), 192  # of one in tiles; low, so that short texts need little padding
HELD = 4 << 20  # bytes of pages that a task hands over at once


# Compression


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes and more by their length, all else as it is, in pieces of at most 128."""
    out, at = [], 0

    def plain(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(bytes((len(part) - 1,)) + part)

    for run in _RUN.finditer(data):
        plain(run.start())
        at = run.end()
        out.append(bytes((257 - at + run.start(), run[0][0])))
    plain(len(data))
    return b"".join(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, held = [], 0, 0
    while at < len(data) and held < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            part = data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
        out.append(part)
        held += len(part)
    return b"".join(out)


#: Bits of the codes that follow a clear; the width grows with the table, one code early.
_WIDTHS = 9 + np.searchsorted([254, 766, 1790], np.arange(1 << 13), "right")
_SINGLES = [bytes((i,)) for i in range(256)] + [b"", b""]
_BITS = np.arange(12)


def lzw_encode(data: bytes) -> bytes:
    codes, starts = [CLEAR], [1]  # starts: the first code after each clear
    table: dict[int, int] = {}
    following, bytes_left = FIRST, iter(data)
    prefix = next(bytes_left, END)
    for byte in bytes_left:
        pair = prefix << 8 | byte
        if pair in table:
            prefix = table[pair]
            continue
        codes.append(prefix)
        table[pair] = following
        following += 1
        prefix = byte
        if following > 4093:
            codes.append(CLEAR)
            starts.append(len(codes))
            table.clear()
            following = FIRST
    codes += [prefix, END] if data else [END]
    ends = [*starts[1:], len(codes)]
    widths = np.concatenate([_WIDTHS[:1], *(_WIDTHS[: b - a] for a, b in zip(starts, ends, strict=True))])[:, None]
    # A row of bits for each code, the highest first, of which its width is taken.
    bits = np.array(codes, np.int64)[:, None] >> np.maximum(widths - 1 - _BITS, 0) & 1
    return np.packbits(bits[widths > _BITS].astype(np.uint8)).tobytes()


def _read_codes(data: np.ndarray, bits: int, at: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """The next codes, as many as one table takes, when so many came since the clear; where each ends.

    data has some bytes to spare behind its bits.
    """
    widths = _WIDTHS[since : since + 4096] if since < 4096 else np.full(4096, 12)
    widths = widths[: (bits - at) // 9 + 1]
    ends = at + np.cumsum(widths)
    ends = ends[: np.searchsorted(ends, bits, "right")]
    widths = widths[: len(ends)]
    first = ends - widths
    byte = first >> 3
    window = data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]
    return window >> (24 - (first & 7) - widths) & ((1 << widths) - 1), ends


def lzw_decode(data: bytes, size: int) -> bytes:
    """All codes up to the next clear are cut at once, then looked up one by one."""
    numbers, bits, at, since = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), 8 * len(data), 0, 0
    table, previous, out, held = list(_SINGLES), b"", [], 0
    while held < size:
        codes, ends = _read_codes(numbers, bits, at, since)
        if not len(codes):
            break
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else len(codes)
        n, first = len(table), len(out)
        for code in codes[:stop].tolist():
            if code < n:
                entry = table[code]
            elif code == n and previous:
                entry = previous + previous[:1]
            else:
                raise ValueError("a code of no entry")
            out.append(entry)
            if previous and n < 4096:
                table.append(previous + entry[:1])
                n += 1
            previous = entry
        held += sum(map(len, out[first:]))
        if stop < len(codes):
            if codes[stop] == END:
                break
            table, previous = list(_SINGLES), b""
            at, since = int(ends[stop]), 0
        else:
            at, since = int(ends[-1]), since + len(codes)
    return b"".join(out)


def _decompress(data: bytes, method: int, size: int) -> bytes:
    if method == NONE:
        return data
    if method == LZW:
        return lzw_decode(data, size)
    if method in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size)
    if method == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {method} is not supported")


# Writing


class Page(NamedTuple):
    """A page to write: unsigned numbers by row, pixel and sample, and how to lay them out."""

    samples: np.ndarray
    compression: int = NONE
    predictor: int = 1
    rows_per_strip: int = 0  # 0: all
    tile: tuple[int, int] | None = None  # rows and pixels of tiles, multiples of 16; None: strips
    planar: bool = False
    bits: int = 0  # 1: bilevel samples, packed; 0: as wide as the numbers


def _laid_out(block: np.ndarray, page: Page, order: str) -> bytes:
    """A strip's or tile's bytes before compression."""
    if page.bits == 1:
        return np.packbits(block.reshape(len(block), -1).astype(bool), axis=1).tobytes()
    if page.predictor == 2:
        block = np.diff(block, axis=1, prepend=block.dtype.type(0))
    if page.predictor == 3:
        rows, pixels, samples = block.shape
        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, pixels * samples, -1).transpose(0, 2, 1)
        planes = np.ascontiguousarray(planes).reshape(rows, -1, samples)
        return np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
    return block.astype(block.dtype.newbyteorder(order)).tobytes()


def _blocks(page: Page) -> Iterator[np.ndarray]:
    """The strips or tiles, plane by plane."""
    planes = np.split(page.samples, page.samples.shape[2], axis=2) if page.planar else [page.samples]
    for plane in planes:
        height, width = plane.shape[:2]
        if page.tile:
            tall, wide = page.tile
            plane = np.pad(plane, [(0, -height % tall), (0, -width % wide), (0, 0)])
            for y in range(0, len(plane), tall):
                for x in range(0, plane.shape[1], wide):
                    yield plane[y : y + tall, x : x + wide]
        else:
            step = page.rows_per_strip or height
            for y in range(0, height, step):
                yield plane[y : y + step]


def encode_pages(pages: Sequence[Page], order: str = "<") -> bytes:
    """A file of some pages, in little-endian or (order ">") big-endian numbers."""
    packers = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 4), PACKBITS: pack_bits}
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4  # where the place of the next directory goes
    for page in pages:
        height, width, samples = page.samples.shape
        offsets, sizes = [], []
        for block in _blocks(page):
            packed = packers[page.compression](_laid_out(block, page, order))
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        bits = page.bits or page.samples.dtype.itemsize * 8
        fields = {WIDTH: [width], LENGTH: [height], BITS: [bits] * samples, COMPRESSION: [page.compression], PHOTOMETRIC: [1], SAMPLES: [samples], PLANAR: [1 + page.planar], PREDICTOR: [page.predictor]}
        fields |= {TILE_WIDTH: [page.tile[1]], TILE_LENGTH: [page.tile[0]], TILE_OFFSETS: offsets, TILE_SIZES: sizes} if page.tile else {ROWS_PER_STRIP: [page.rows_per_strip or height], STRIP_OFFSETS: offsets, STRIP_SIZES: sizes}
        out += b"\0" * (len(out) & 1)
        struct.pack_into(f"{order}I", out, link, len(out))
        after = len(out) + 2 + 12 * len(fields) + 4
        entries, extra = struct.pack(f"{order}H", len(fields)), b""
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                place, extra = after + len(extra), extra + packed
                packed = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + packed
        link = len(out) + len(entries)
        out += entries + b"\0\0\0\0" + extra
    return bytes(out)


def encode(samples: bytes, width: int, compression: int, predictor: int = 1, rows_per_strip: int = 0, tile: tuple[int, int] | None = None) -> bytes:
    """A one-page grey file of 8-bit samples."""
    return encode_pages([Page(np.frombuffer(samples, np.uint8).reshape(-1, width, 1), compression, predictor, rows_per_strip, tile)])


# Reading


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The fields of each image directory, in the file's order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        fields: dict = {0: (order,)}
        (n,) = struct.unpack_from(f"{order}H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                form = f"{order}{count}{TYPES[kind]}"
                place = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(f"{order}I", data, place)
                fields[tag] = struct.unpack_from(form, data, place)
        yield fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _restore(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Undo a predictor; block is rows x pixels x samples in native byte order."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:  # bytes of a row, most significant plane first, as differences
        rows, pixels, samples = block.shape
        size = block.dtype.itemsize
        raw = block.astype(block.dtype.newbyteorder(order), copy=False).view(np.uint8).reshape(rows, -1)
        stride = raw.reshape(rows, pixels * size, samples)
        planes = np.cumsum(stride, axis=1, dtype=np.uint8).reshape(rows, size, pixels * samples)
        whole = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}")
        return whole.reshape(rows, pixels, samples).astype(block.dtype)
    return block


_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_samples(data: bytes, fields: dict[int, tuple]) -> bytes:
    """A page's samples in little-endian order, row by row; planes one after another."""
    order = fields[0][0]
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, method = one(WIDTH, 0), one(LENGTH, 0), one(COMPRESSION, NONE)
    samples, bits, predictor = one(SAMPLES, 1), one(BITS, 1), one(PREDICTOR, 1)
    if predictor not in (1, 2, 3):
        raise ValueError(f"unknown predictor {predictor}")
    if (fill := one(FILL_ORDER, 1)) not in (1, 2):
        raise ValueError(f"unknown fill order {fill}")
    if len(set(fields.get(BITS, (1,)))) > 1:
        raise ValueError("samples of unlike bits")
    if predictor != 1 and (bits % 8 or bits > 64):
        raise ValueError(f"predictor {predictor} with {bits} bits")
    planes = samples if one(PLANAR, 1) == 2 else 1
    samples //= planes
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets = fields[TILE_OFFSETS if tiled else STRIP_OFFSETS]
    sizes = fields.get(TILE_SIZES if tiled else STRIP_SIZES) or (len(data),) * len(offsets)
    if not (width and height and across and down):
        raise ValueError("a page without samples")
    if bits % 8 or bits > 64:
        if tiled or bits > 64:
            raise ValueError(f"{bits} bits in tiles are not supported")
        line = -(-width * samples * bits // 8)
        across, samples_, unit = line, 1, np.dtype(np.uint8)
        width, samples, predictor = line, samples_, 1
    else:
        unit = np.dtype(f"{order}u{bits // 8}")
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) != planes * columns * rows:
        raise ValueError(f"{len(offsets)} strips or tiles of {planes * columns * rows}")
    out = np.zeros((planes, height, width, samples), unit.newbyteorder("<"))
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, y, x = i // (columns * rows), i // columns % rows * down, i % columns * across
        tall = down if tiled else min(down, height - y)
        need = tall * across * samples * unit.itemsize
        if at >= len(data):
            raise ValueError(f"strip or tile {i} lies beyond the file")
        kept = data[at : at + size]
        raw = _decompress(kept.translate(_REVERSED) if fill == 2 else kept, method, need)[:need]
        if len(raw) < need:
            raise ValueError(f"strip or tile {i} ends after {len(raw)} of {need} bytes")
        block = np.frombuffer(raw, unit).reshape(tall, across, samples)
        block = _restore(block.astype(unit.newbyteorder("=")), predictor, order)
        out[plane, y : y + tall, x : x + across] = block[: height - y, : width - x]
    return out.tobytes()


_BROKEN = (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)


def _file_pages(data: bytes | None) -> Iterator[tuple]:
    """Values of PAGE_FIELDS for each page."""

    def broken(page: int, e: Exception) -> tuple:
        return (page, *[None] * 7, f"{type(e).__name__}: {e}"[:200])

    page = 0
    try:
        for fields in directories(data) if data else ():
            one = lambda tag, default, f=fields: int(f.get(tag, (default,))[0])
            shape = (one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1))
            try:
                found = (page, *shape, page_samples(data, fields), None)
            except _BROKEN as e:
                found = broken(page, e)
            yield found
            page += 1
    except _BROKEN as e:
        yield broken(page, e)


def tiff_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for every page of every file: files' other columns, then PAGE_FIELDS.

    A field whose name files uses already gets underscores behind it until it is new.
    """
    kept = [c for c in files.columns if c != content]

    def free(name: str) -> str:
        return free(f"{name}_") if name.lower() in {c.lower() for c in kept} else name

    def make(contents: list[bytes | None]) -> Iterator[tuple[list[int], list]]:
        of, rows, held = [], [], 0
        for i, data in enumerate(contents):
            for row in _file_pages(data):
                of.append(i)
                rows.append(row)
                held += len(row[7] or b"")
                if held > HELD:
                    yield of, list(zip(*rows, strict=True))
                    of, rows, held = [], [], 0
        if rows:
            yield of, list(zip(*rows, strict=True))

    return scan(files, kept, [content], lambda: make, [(free(n), kind, arrow) for n, kind, arrow in PAGE_FIELDS])


def text_image(text: str | None) -> tuple[int, bytes]:
    """A text's bytes before padding, and its file.

    A checksum of the payload chooses codec, predictor and layout, so each of them
    meets texts of every size, and equal texts give equal files.
    """
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)
    at = zlib.crc32(payload)
    method, predictor = (LZW, DEFLATE, PACKBITS)[at % 3], 1 + at // 3 % 2
    if at // 6 % 2:
        return len(raw), encode(payload, TILED_WIDTH, method, predictor, tile=TILE)
    return len(raw), encode(payload, BLOCK, method, predictor, rows_per_strip=STRIP)


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the TIFF file (content) of each document's text."""

    def make(texts: list[str | None]) -> Iterator[tuple[range, list]]:
        if texts:
            made = [text_image(t) for t in texts]
            yield range(len(made)), list(zip(*made, strict=True))

    return scan(docs, ["doc_id"], ["text"], lambda: make, [("n_bytes", "long", pa.int64()), ("content", "binary", pa.binary())])


def text_digest(stored: DataFrame) -> DataFrame:
    """Read the files of :func:`store_text` back and describe what they hold."""
    files = stored.withColumn("media_bytes", F.octet_length("content").cast("long")).withColumn("media_sha256", F.sha2("content", 256))
    pages = tiff_pages(files).withColumn("payload_bytes", F.octet_length("samples").cast("long"))
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("width", "height", "bits", "compression", "predictor")), F.concat(F.lit("crc32="), F.hex(F.crc32("samples"))))
    return pages.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
