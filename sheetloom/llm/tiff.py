"""TIFF pages: a reader of image directories and a writer of 8-bit grey ones.

The reader walks the chain of image directories of either byte order, decodes strips and tiles (stored,
PackBits, LZW, deflate), undoes horizontal and floating-point prediction, and gives each page's samples.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: tags, compression schemes, bytes by field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
TYPE_LETTER = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader can decode."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes
    tags: dict[int, tuple] = field(default_factory=dict, repr=False)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, everything else literally."""
    out, literal, i = bytearray(), bytearray(), 0

    def put() -> None:
        for a in range(0, len(literal), 128):
            part = literal[a : a + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            put()
            out += bytes((257 - (j - i), data[i]))
        else:
            literal += data[i:j]
        i = j
    put()
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends; widths grow one code early."""
    table: list[bytes] = []
    out, held, bits, width, before = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes((b,)) for b in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data doesn't begin with a clear code")
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise TiffError("LZW code beyond the table")
        out += now
        if before:
            table.append(before + now[:1])
        before = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """The coding that :func:`unlzw` reads."""
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, now = {bytes((b,)): b for b in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for b in data:
        more = now + bytes((b,))
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more] = following
        following += 1
        now = bytes((b,))
        if following == 4094:
            put(table[now], width)
            put(256, width)
            table, width, now, following = {bytes((b,)): b for b in range(256)}, 9, b"", 258
        elif following > (1 << width) - 1:
            width += 1
    if now:
        put(table[now], width)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


def _decode(data: bytes, how: int) -> bytes:
    if how == STORED:
        return data
    if how == PACKBITS:
        return unpackbits(data)
    if how == LZW:
        return unlzw(data)
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {how} isn't supported")


def _undo(raw: np.ndarray, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """raw: rows of bytes of one strip or tile, ``width`` pixels each. The rows with prediction undone."""
    if predictor == 1:
        return raw
    size = bits // 8
    if predictor == 2 and bits in (8, 16, 32, 64):
        values = raw.view(np.dtype(f"{order}u{size}") if size > 1 else np.uint8).reshape(len(raw), width, samples)
        whole = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
        return whole.astype(values.dtype).reshape(len(raw), -1).view(np.uint8)
    if predictor == 3 and bits in (16, 32, 64):  # byte planes, highest first, each byte less the one `samples` before
        planes = np.cumsum(raw.reshape(len(raw), -1, samples), axis=1, dtype=np.uint8).reshape(len(raw), size, width * samples)
        values = planes.transpose(0, 2, 1)
        return np.ascontiguousarray(values if order == ">" else values[:, :, ::-1]).reshape(len(raw), -1)
    raise TiffError(f"predictor {predictor} of {bits} bits isn't supported")


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF, in order. Raises TiffError for what isn't one, is cut short, or has a directory cycle."""
    try:
        yield from _pages(data)
    except (struct.error, IndexError, ZeroDivisionError) as e:
        raise TiffError(f"cut short or inconsistent: {e}") from e


def _pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("directories form a cycle")
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = TYPE_BYTES.get(kind, 0) * n
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if kind in TYPE_LETTER:
                tags[tag] = struct.unpack_from(f"{order}{n}{TYPE_LETTER[kind]}", data, where)
        yield _page(data, len(seen) - 1, tags, order)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def _page(data: bytes, number: int, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, how, predictor = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(COMPRESSION, STORED), one(PREDICTOR, 1)
    depths = tags.get(BITS, (1,))
    if len(set(depths)) > 1:
        raise TiffError("samples of different depth aren't supported")
    bits, planes = depths[0], samples if one(PLANAR, 1) == 2 else 1
    tiled = TILE_OFFSETS in tags
    if tiled:
        wide, tall = one(TILE_WIDTH, width), one(TILE_LENGTH, height)
        offsets, sizes = tags[TILE_OFFSETS], tags.get(TILE_SIZES, ())
    else:
        wide, tall = width, min(one(ROWS_PER_STRIP, height), height) or 1
        offsets, sizes = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_SIZES, ())
    if not width or not height or not wide or not tall:
        raise TiffError("a page without width or height")
    across, down = math.ceil(width / wide), math.ceil(height / tall)
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise TiffError("strips or tiles are missing")
    own = samples // planes
    row_bytes, full_bytes = (wide * own * bits + 7) // 8, (width * own * bits + 7) // 8
    if tiled and (wide * own * bits) % 8:
        raise TiffError("tiles of partial bytes aren't supported")
    rows = np.zeros((planes, height, full_bytes), dtype=np.uint8)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = divmod(cell, across)
        lines = tall if tiled else min(tall, height - y * tall)
        if offsets[k] + sizes[k] > len(data):
            raise TiffError("a strip or tile lies beyond the end")
        raw = _decode(data[offsets[k] : offsets[k] + sizes[k]], how)
        if len(raw) < lines * row_bytes:
            raise TiffError("a strip or tile is too short")
        block = _undo(np.frombuffer(raw, np.uint8, lines * row_bytes).reshape(lines, row_bytes), wide, own, bits, predictor, order)
        y0, x0 = y * tall, x * row_bytes
        part = block[: height - y0, : full_bytes - x0]
        rows[plane, y0 : y0 + len(part), x0 : x0 + part.shape[1]] = part
    if planes > 1 and bits % 8:
        raise TiffError("separate planes of partial bytes aren't supported")
    if planes > 1:  # to one pixel's samples next to each other
        rows = rows.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return Page(number, width, height, samples, bits, how, predictor, tiled, np.ascontiguousarray(rows).tobytes(), tags)


def write_grey(images: list[tuple[bytes, int]], compression: int = DEFLATE, predictor: int = 1, strip_bytes: int = 1 << 16, level: int = 6) -> bytes:
    """A little-endian TIFF with a page of 8-bit grey samples per (samples, width); their number is a multiple of the width."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for samples, width in images:
        if not samples or len(samples) % width:
            raise TiffError("a page needs whole rows")
        rows = max(1, strip_bytes // width)
        offsets, sizes = [], []
        for at in range(0, len(samples), rows * width):
            part = samples[at : at + rows * width]
            if predictor == 2:
                grid = np.frombuffer(part, np.uint8).reshape(-1, width)
                part = np.concatenate((grid[:, :1], np.diff(grid, axis=1)), axis=1).tobytes()
            part = part if compression == STORED else packbits(part) if compression == PACKBITS else lzw(part) if compression == LZW else zlib.compress(part, level)
            offsets.append(len(out))
            sizes.append(len(part))
            out += part + b"\0" * (len(part) % 2)
        entries = [(WIDTH, width), (LENGTH, len(samples) // width), (BITS, 8), (COMPRESSION, compression), (PHOTOMETRIC, 1), (STRIP_OFFSETS, offsets), (SAMPLES, 1), (ROWS_PER_STRIP, rows), (STRIP_SIZES, sizes), (PREDICTOR, predictor)]
        fields = []
        for tag, value in entries:
            values = value if isinstance(value, list) else [value]
            if len(values) > 1:
                place, many = len(out), struct.pack(f"<{len(values)}I", *values)
                out += many
                fields.append(struct.pack("<HHII", tag, 4, len(values), place))
            else:
                fields.append(struct.pack("<HHII", tag, 4, 1, values[0]))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
