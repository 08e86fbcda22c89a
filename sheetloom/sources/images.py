"""Kinds, displayed sizes and orientations of pictures from their headers; no pixels are touched."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

HEADER = "image_kind string, image_width long, image_height long, orientation int"


def _orientation(tiff: bytes) -> int:
    """The orientation that a picture's directory of tags states, 1 if it states none that is known."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return 1
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(n):
        if at + 14 + 12 * i > len(tiff):
            return 1
        tag, kind = struct.unpack_from(order + "HH", tiff, at + 2 + 12 * i)
        if tag == 0x0112 and kind == 3:
            (found,) = struct.unpack_from(order + "H", tiff, at + 10 + 12 * i)
            return found if 1 <= found <= 8 else 1
    return 1


def _jpeg(data: bytes) -> tuple[int, int, int] | None:
    at, turn = 2, 1
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
            continue
        if mark in (0x01, *range(0xD0, 0xD9)):  # marks without a length
            at += 2
            continue
        if mark in (0xD9, 0xDA):  # pixels, and no size before them
            return None
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        if length < 2 or len(body) < length - 2:
            return None
        if mark == 0xE1 and body[:6] == b"Exif\x00\x00":
            turn = _orientation(body[6:])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), turn) if len(body) >= 5 else None
        at += 2 + length
    return None


def _webp(data: bytes) -> tuple[int, int, int] | None:
    kind, size, turn, at = data[12:16], None, 1, 12
    if kind == b"VP8X" and len(data) >= 30:
        size = int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        while at + 8 <= len(data):  # the chunks after the canvas may state an orientation
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                body = data[at + 8 : at + 8 + n]
                turn = _orientation(body[6:] if body[:6] == b"Exif\x00\x00" else body)
            at += 8 + n + n % 2
    elif kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    elif kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        size = int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    return (*size, turn) if size else None


def header(data: bytes | None) -> tuple[str | None, int | None, int | None, int | None]:
    """kind ('jpeg', 'png' or 'webp'), displayed width and height, and orientation; the sizes of a damaged header are null, and all is for other kinds."""
    data = data or b""
    if data[:2] == b"\xff\xd8":
        kind, found = "jpeg", _jpeg(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        whole = len(data) >= 24 and data[12:16] == b"IHDR"
        kind, found = "png", (int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), 1) if whole else None
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind, found = "webp", _webp(data)
    else:
        return None, None, None, None
    if not found or not found[0] or not found[1]:
        return kind, None, None, None
    width, height, turn = found
    return (kind, height, width, turn) if turn >= 5 else (kind, width, height, turn)


def with_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without the content, with HEADER's columns: sizes are those after the orientation is undone, as a picture is shown. Null content is of no kind."""
    others = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(x.as_py()) for x in batch.column(len(others))]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32()]
            told = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *told], [*others, "image_kind", "image_width", "image_height", "orientation"])

    kept = files.select(*others, content)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != content)
    return kept.mapInArrow(run, f"{shape}, {HEADER}" if shape else HEADER)
