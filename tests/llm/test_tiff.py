import hashlib
import struct
import zlib

import numpy as np
import pytest
from binomia.llm import registry, tiff
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_long_lzw():
    r = np.random.default_rng(0)
    for data in (bytes(r.integers(0, 256, 60_000, dtype=np.uint8)), b"abc" * 40_000, bytes(r.integers(0, 3, 90_000, dtype=np.uint8))):
        assert tiff.unlzw(tiff.lzw(data)) == data


def test_known_lzw():
    """The format's own worked example: 7 7 7 8 8 7 7 6 6."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unlzw(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages(compression, predictor, tile, order):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 9, (37, 50, 1), dtype=np.uint8), r.integers(0, 256, (5, 70, 3), dtype=np.uint8)]
    data = tiff.write(pages, compression, predictor, tile, strip_bytes=400, order=order)
    got = [tiff.samples(data, f) for f in tiff.directories(data)]
    assert len(got) == 2 and all((a == b).all() for a, b in zip(got, pages, strict=True))


def raw_tiff(fields, data, order="<"):
    """A one-page file with the data right after the header; values that fit stay inline."""
    at = 8 + len(data) + len(data) % 2
    out = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack(order + "H", len(fields))
    for tag, kind, value in fields:
        out += struct.pack(order + "HHI", tag, kind, 1) + struct.pack(order + {3: "H2x", 4: "I"}[kind], value)
    return out + struct.pack(order + "I", 0)


def test_bits_and_wide_samples():
    one = raw_tiff([(256, 4, 10), (257, 4, 2), (258, 3, 1), (259, 3, 1), (273, 4, 8), (278, 4, 2), (279, 4, 4)], b"\xaa\x80\x55\x40")
    page = tiff.samples(one, next(tiff.directories(one)))
    assert page[:, :, 0].tolist() == [[1, 0] * 5, [0, 1] * 5]
    wide = raw_tiff([(256, 4, 3), (257, 4, 1), (258, 3, 16), (259, 3, 8), (273, 4, 8), (278, 4, 1), (279, 4, len(zlib.compress(b"\x01\x00\x00\x01\xff\xff"))), (317, 3, 2)], zlib.compress(b"\x01\x00\x00\x01\xff\xff"), ">")
    assert tiff.samples(wide, next(tiff.directories(wide)))[0, :, 0].tolist() == [256, 257, 256]


def test_broken_images_give_errors(spark):
    good = tiff.write([np.zeros((3, 4, 1), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    rows = [(1, bytearray(good)), (2, None), (3, bytearray()), (4, bytearray(b"II*\0\xff\xff\xff\xff")), (5, bytearray(good[:-20])), (6, loop)]
    got = tiff.read_pages(spark.createDataFrame(rows, "doc_id bigint, media binary")).collect()
    by = {i: [r for r in got if r.doc_id == i] for i in range(1, 7)}
    assert by[1][0].error is None and (by[1][0].width, by[1][0].height) == (4, 3)
    assert all(len(by[i]) == 1 and by[i][0].error and by[i][0].samples is None for i in (2, 3, 4, 5))
    assert by[6][0].error is None and "loop" in by[6][1].error


def test_query(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op10_tiff"](spark, f"file://{tmp_path}").collect()
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got)
    assert len({r.media_sha256 for r in got}) == len({r.payload_sha256 for r in got}) == len({r.feature for r in got})
    assert tiff.read_pages(tiff.stored(no_docs)).collect() == []


def test_absurd_sizes_give_errors(spark):
    """Sizes of nothing, missing tile sizes, huge pages, and a small stored part that decodes to much: an error row each."""
    base = [(256, 4, 10), (257, 4, 2), (258, 3, 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 2), (279, 4, 20), (284, 3, 1)]
    with_ = lambda **new: [(t, k, new.get(f"t{t}", v)) for t, k, v in base]
    tiles = [(256, 4, 10), (257, 4, 2), (258, 3, 8), (259, 3, 1), (324, 4, 8), (325, 4, 20)]
    fields = [with_(t278=0), with_(t277=0, t284=2), with_(t256=0), with_(t256=2**31, t257=2**31), with_(t256=40_000, t257=20_000, t278=20_000), with_(t259=9), tiles, [*tiles[:4], (322, 4, 0), (323, 4, 0), *tiles[4:]]]
    bomb = zlib.compress(b"\0" * (64 << 20))
    rows = [(i, raw_tiff(f, b"x" * 20)) for i, f in enumerate(fields)]
    good = raw_tiff(base, b"x" * 20)
    small = raw_tiff([(256, 4, 10), (257, 4, 2), (258, 3, 8), (259, 3, 8), (273, 4, 8), (278, 4, 2), (279, 4, len(bomb))], bomb)
    rows += [(100, good), (101, small)]
    got = {r.doc_id: r for r in tiff.read_pages(spark.createDataFrame([(i, bytearray(m)) for i, m in rows], "doc_id bigint, media binary")).collect()}
    assert len(got) == len(rows) and all(got[i].error and got[i].samples is None for i in range(len(fields)))
    assert got[100].samples == b"x" * 20 and got[101].samples == b"\0" * 20


def test_many_pages_of_one_file(spark):
    """Pages that hold much more than their file come in several batches, in order."""
    pages = [np.full((3000, 2000, 1), i, np.uint8) for i in range(8)]
    got = tiff.read_pages(spark.createDataFrame([(1, bytearray(tiff.write(pages)))], "doc_id bigint, media binary")).select("page_index", "width", "height", "feature").collect()
    assert [(r.page_index, r.width, r.height) for r in got] == [(i, 2000, 3000) for i in range(8)]
