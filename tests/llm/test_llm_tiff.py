"""TIFF: files built by hand, round trips in every form, and broken ones."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import tiff

RNG = np.random.default_rng(6)


def by_hand(order, fields, data, following=0):
    """A one-page file: data, then a directory with values of up to four bytes."""
    at = 8 + len(data)
    head = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at)
    out = head + data + struct.pack(f"{order}H", len(fields))
    for tag, kind, values in sorted(fields):
        out += struct.pack(f"{order}HHI", tag, kind, len(values)) + struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values).ljust(4, b"\0")
    return out + struct.pack(f"{order}I", at if following else 0)


def one_page(order, bits, width, height, data, samples=1, compression=1, predictor=1, size=None, at=8, loop=0):
    short, long = 3, 4
    fields = [(256, short, [width]), (257, short, [height]), (258, short, [bits]), (259, short, [compression]), (277, short, [samples]), (278, long, [height]), (273, long, [at]), (279, long, [len(data) if size is None else size]), (317, short, [predictor])]
    return by_hand(order, fields, data, loop)


def samples_of(file):
    return [(p[7], p[8]) for p in tiff._file_pages(file)]


@pytest.mark.parametrize("order", "<>")
def test_files_built_by_hand(order):
    wide = [1, 300, 65535, 7, 8, 9]
    assert samples_of(one_page(order, 16, 3, 2, struct.pack(f"{order}6H", *wide))) == [(struct.pack("<6H", *wide), None)]
    steps = np.diff(np.array(wide, np.uint16).reshape(2, 3), axis=1, prepend=np.uint16(0)).ravel().tolist()
    assert samples_of(one_page(order, 16, 3, 2, struct.pack(f"{order}6H", *steps), predictor=2)) == [(struct.pack("<6H", *wide), None)]
    assert samples_of(one_page(order, 1, 10, 2, b"\xaa\x80\x55\x40")) == [(b"\xaa\x80\x55\x40", None)]
    assert samples_of(one_page(order, 8, 4, 1, b"\xfe\x07\x01\x05\x06", compression=32773)) == [(b"\x07\x07\x07\x05", None)]
    # 1.0 and 2.0 as floats: their bytes by significance, then as differences.
    planes = np.frombuffer(struct.pack(">2f", 1.0, 2.0), np.uint8).reshape(2, 4).T.ravel()
    assert samples_of(one_page(order, 32, 2, 1, np.diff(planes, prepend=np.uint8(0)).tobytes(), predictor=3)) == [(struct.pack("<2f", 1.0, 2.0), None)]
    # LZW: clear, 7, 7 7, end in nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 257)).ljust(40, "0")
    assert samples_of(one_page(order, 8, 3, 1, int(bits, 2).to_bytes(5, "big"), compression=5)) == [(b"\7\7\7", None)]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("method", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages_of_every_form(order, method):
    pages, wanted = [], []
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        for samples, planar in ((1, False), (3, False), (3, True)):
            for predictor in (1, 2, 3):
                for layout in ({}, {"rows_per_strip": 5}, {"tile": (16, 16)}, {"tile": (32, 16)}):
                    image = RNG.integers(0, 9, (21, 19, samples)).astype(kind) * kind(RNG.integers(1, 29))
                    pages.append(tiff.Page(image, method, predictor, planar=planar, **layout))
                    wanted.append((image.transpose(2, 0, 1) if planar else image).astype(image.dtype.newbyteorder("<")).tobytes())
    bilevel = RNG.integers(0, 2, (9, 13, 1))
    pages.append(tiff.Page(bilevel.astype(np.uint8), method, rows_per_strip=4, bits=1))
    wanted.append(np.packbits(bilevel[:, :, 0].astype(bool), axis=1).tobytes())
    assert samples_of(tiff.encode_pages(pages, order)) == [(w, None) for w in wanted]


def test_broken_files_give_errors_not_zeros():
    grey = np.full((8, 8, 1), 9, np.uint8)
    whole = one_page("<", 8, 8, 8, grey.tobytes())
    assert samples_of(whole)[0][1] is None
    for broken in (one_page("<", 8, 8, 8, grey.tobytes(), size=10), one_page("<", 8, 8, 8, grey.tobytes(), at=100_000), one_page("<", 8, 0, 8, b"x"), one_page("<", 8, 8, 8, b"\x00", compression=99), one_page("<", 8, 8, 8, zlib.compress(bytes(range(64)))[:40], compression=8), one_page("<", 8, 8, 8, tiff.lzw_encode(bytes(range(64)))[:20], compression=5)):
        assert [(data, error is not None) for data, error in samples_of(broken)] == [(None, True)]
    # A page that can't be read does not hide the one behind it.
    both = bytearray(tiff.encode_pages([tiff.Page(grey, tiff.DEFLATE), tiff.Page(grey)]))
    both[8:12] = b"junk"
    assert [(data, error is None) for data, error in samples_of(bytes(both))] == [(None, False), (grey.tobytes(), True)]
    assert len(samples_of(one_page("<", 8, 8, 8, grey.tobytes(), loop=1))) == 1
    assert [error is not None for _, error in samples_of(whole[:-20])] == [True]


@pytest.mark.parametrize("size", [1, 255, 4000, 4100, 70_000, 300_000])
def test_codecs_of_all_sizes(size):
    rng = random.Random(size)
    for data in (rng.randbytes(size), bytes(size), bytes(rng.choices(b"abc de", k=size))):
        assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data
        assert tiff.unpack_bits(tiff.pack_bits(data), size) == data


def test_pages_keep_all_other_columns(spark):
    file = tiff.encode(bytes(range(48)), 48, tiff.LZW)
    made = spark.createDataFrame([(2**60 + 1, file, "mine", [1, None]), (None, None, None, None), (5, b"not a file", "", [])], "doc_id long, content binary, page string, parts array<int>")
    rows = {r["doc_id"]: r for r in tiff.tiff_pages(made).collect()}
    assert set(rows) == {2**60 + 1, 5}
    assert (rows[2**60 + 1]["page"], rows[2**60 + 1]["page_"], rows[2**60 + 1]["parts"], rows[2**60 + 1]["samples"]) == ("mine", 0, [1, None], bytes(range(48)))
    assert rows[5]["error"].startswith("ValueError")


def test_digest_against_plain_python(spark):
    rng = random.Random(2)
    texts = ["", None, "é" * 288, "x" * 577, *("".join(rng.choices("ab cdé\n", k=rng.choice([5, 600, 3000, 60_000]))) for _ in range(40))]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tiff.text_digest(tiff.store_text(made)).collect()}
    forms = set()
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(-(-max(len(raw), 1) // 576) * 576, b"\xff")
        n, file = tiff.text_image(text)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (n, r["media_bytes"], r["media_sha256"]) == (len(raw), len(file), hashlib.sha256(file).hexdigest())
        forms.add(tuple(f.split("=")[1] for f in r["feature"].split(";") if f.startswith(("comp", "pred", "width"))))
    assert len(forms) == 12  # every codec with both predictors, in strips and in tiles
    assert tiff.text_digest(tiff.store_text(made.where(F.lit(False)))).count() == 0
