import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheetloom.llm import media, queries, tiff


@given(st.binary(max_size=3000))
def test_codes_round_trip(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data
    assert tiff.unlzw(tiff.lzw(data)) == data


@pytest.mark.parametrize("n", [255, 511, 512, 1000, 4095, 5000, 30_000])
@pytest.mark.parametrize("k", [1, 3, 256])
def test_lzw_at_width_changes(n, k):
    dice = random.Random(n)
    data = bytes(dice.randrange(k) for _ in range(n))
    assert tiff.unlzw(tiff.lzw(data)) == data


def test_lzw_of_the_specification():
    # 7 7 7 8 8 7 7 6 6 is coded as 256 7 258 8 8 258 6 6 257 in nine bits each
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert tiff.unlzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


@pytest.mark.parametrize("compression", [tiff.STORED, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(compression, predictor):
    images = [(random.Random(i).randbytes(64 * n), 64) for i, n in enumerate((1, 5, 1100))] + [(b"hello, " * 64, 7)]
    found = list(tiff.pages(tiff.write_grey(images, compression, predictor)))
    assert [(p.data, p.width, p.number, p.predictor) for p in found] == [(d, w, i, predictor) for i, (d, w) in enumerate(images)]


def build(order, entries, blobs):
    """A one-page TIFF: entries (tag, type, values), blobs placed after the header; values may be ('at', i) for a blob's place."""
    places, data = [], bytearray(8)
    for b in blobs:
        places.append(len(data))
        data += b
    fields = b""
    for tag, kind, values in sorted(entries):
        values = [places[v[1]] if isinstance(v, tuple) else v for v in values]
        packed = struct.pack(f"{order}{len(values)}{tiff.TYPE_LETTER[kind]}", *values)
        if len(packed) > 4:
            place = len(data)
            data += packed
            packed = struct.pack(order + "I", place)
        fields += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    struct.pack_into(order + "I", data, 4, len(data))
    data[:4] = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 42)
    return bytes(data + struct.pack(order + "H", len(entries)) + fields + bytes(4))


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_samples_and_float_prediction(order):
    dice = np.random.default_rng(5)
    grid = dice.integers(0, 256, (20, 21, 3), dtype=np.uint8)  # 16 x 16 tiles, three samples, horizontal prediction
    padded = np.zeros((32, 32, 3), np.uint8)
    padded[:20, :21] = grid
    tiles = []
    for y in (0, 16):
        for x in (0, 16):
            t = padded[y : y + 16, x : x + 16]
            tiles.append(zlib.compress(np.concatenate((t[:, :1], np.diff(t, axis=1)), axis=1).tobytes()))
    at = [("at", i) for i in range(4)]
    entries = [(tiff.WIDTH, 3, [21]), (tiff.LENGTH, 3, [20]), (tiff.BITS, 3, [8, 8, 8]), (tiff.COMPRESSION, 3, [tiff.OLD_DEFLATE]), (tiff.SAMPLES, 3, [3]), (tiff.PREDICTOR, 3, [2]), (tiff.TILE_WIDTH, 3, [16]), (tiff.TILE_LENGTH, 3, [16]), (tiff.TILE_OFFSETS, 4, at), (tiff.TILE_SIZES, 4, list(map(len, tiles)))]
    (page,) = tiff.pages(build(order, entries, tiles))
    assert page.tiled and page.data == grid.tobytes()

    values = dice.normal(size=(6, 9)).astype(f"{order}f4")
    raw = values.astype(">f4").view(np.uint8).reshape(6, 9, 4).transpose(0, 2, 1).reshape(6, 36)
    coded = np.concatenate((raw[:, :1], np.diff(raw, axis=1)), axis=1).tobytes()
    strips = [tiff.lzw(coded[:144]), tiff.lzw(coded[144:])]
    entries = [(tiff.WIDTH, 3, [9]), (tiff.LENGTH, 3, [6]), (tiff.BITS, 3, [32]), (tiff.COMPRESSION, 3, [tiff.LZW]), (tiff.PREDICTOR, 3, [3]), (tiff.SAMPLE_FORMAT, 3, [3]), (tiff.ROWS_PER_STRIP, 3, [4]), (tiff.STRIP_OFFSETS, 4, at[:2]), (tiff.STRIP_SIZES, 4, list(map(len, strips)))]
    (page,) = tiff.pages(build(order, entries, strips))
    assert page.data == values.tobytes()

    wide = dice.integers(0, 65536, (4, 10)).astype(f"{order}u2")
    steps = np.concatenate((wide[:, :1], np.diff(wide.astype(np.uint16), axis=1)), axis=1).astype(wide.dtype)
    entries = [(tiff.WIDTH, 3, [10]), (tiff.LENGTH, 3, [4]), (tiff.BITS, 3, [16]), (tiff.COMPRESSION, 3, [tiff.PACKBITS]), (tiff.PREDICTOR, 3, [2]), (tiff.STRIP_OFFSETS, 4, at[:1]), (tiff.STRIP_SIZES, 4, [len(b := tiff.packbits(steps.tobytes()))])]
    (page,) = tiff.pages(build(order, entries, [b]))
    assert page.data == wide.tobytes()


def test_faults_are_told():
    good = tiff.write_grey([(bytes(64 * 9), 64)])
    for bad in (b"", b"II", b"PK\3\4" * 9, good[:30], good[:-20], good.replace(b"II*\0", b"II+\0")):
        with pytest.raises(tiff.TiffError):
            list(tiff.pages(bad))
    cycle = bytearray(good)
    cycle[-4:] = struct.pack("<I", struct.unpack_from("<I", good, 4)[0])
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(bytes(cycle)))


def check(rows, docs):
    want = []
    for doc_id, text in docs:
        raw = (text or "").encode()
        data = media.payload(text)
        assert len(data) % 64 == 0 and data
        want.append((doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows], key=key) == sorted(want, key=key)
    assert len({(r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.op8_tiff_media(spark, sf_dir).collect(), docs)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    for how, predictor in ((tiff.DEFLATE, 2), (tiff.PACKBITS, 1)):
        paged = media.tiff_pages(media.store_as_tiff(odd_docs, how, predictor))
        check(media.page_features(paged).collect(), [(r[0], r[1]) for r in odd_rows])
    assert media.tiff_pages(media.store_as_tiff(no_docs)).count() == 0
    two = tiff.write_grey([(bytes(64), 64), (b"a" * 128, 64)])
    stored = spark.createDataFrame([(1, 5, two), (2, 5, b"junk"), (3, 5, None)], media.STORED)
    rows = media.tiff_pages(stored).collect()
    assert [(r.doc_id, r.page, r.height, bool(r.error)) for r in sorted(rows, key=lambda r: (r.doc_id, r.page or 0))] == [(1, 0, 1, False), (1, 1, 2, False), (2, None, None, True), (3, None, None, True)]
    assert media.page_features(media.tiff_pages(stored)).count() == 4
