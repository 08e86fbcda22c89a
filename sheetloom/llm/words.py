"""Words of whole texts as 64-bit hashes, computed over the bytes of many texts at once.

A word is a maximal run of bytes of one class, A-Z lower-cased first. Both classes below hold every byte of
a multi-byte UTF-8 character, so splitting bytes is splitting characters. Two different words share a hash
with probability 2**-64 or so per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word bytes are all but white space: [^\x20\x09-\x0D].
SPACED = np.array([b not in (0x20, *range(0x09, 0x0E)) for b in range(256)])
#: Word bytes are digits, letters and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text.
LETTERS = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_LONG = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWER = np.concatenate(([np.uint64(1)], np.cumprod(np.full(_LONG - 1, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about 2 MB of text, or one longer text."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, side="right")) - 1)
        yield at, to
        at = to


def word_hashes(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text (a string array), in order, and the number of words before each text (one longer than texts). A null text has no words."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets -= offsets[0]
    inside = kind[data]
    edges = np.zeros(len(data) + 1, dtype=bool)  # a text begins or ends here
    edges[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edges[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edges[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = last - first
    at = np.flatnonzero(inside) - np.repeat(first, lengths)
    within = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hashed = np.add.reduceat(_BYTE[data[inside]] * _POWER[np.minimum(at, _LONG - 1)], within)
    hashed = mix(hashed + lengths.astype(np.uint64) * _ODD)
    for i in np.flatnonzero(lengths > _LONG).tolist():
        hashed[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return hashed, counts


def shingle_sets(texts: pa.Array, words: int, kind: np.ndarray = SPACED) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` words of each text; of the whole sequence, if a text has fewer words but some; none without words."""
    out: list[np.ndarray] = []
    for at, to in slices(texts):
        hashed, counts = word_hashes(texts.slice(at, to - at), kind)
        m = len(hashed) - words + 1
        runs = mix(hashed[: max(m, 0)] + np.uint64(words))
        for j in range(1, words):
            runs = mix(runs * _ODD + hashed[j : j + max(m, 0)])
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if b - a >= words:
                own = np.sort(runs[a : b - words + 1])
            elif b > a:
                own = mix(hashed[a : a + 1] + np.uint64(b - a))
                for j in range(1, b - a):
                    own = mix(own * _ODD + hashed[a + j : a + j + 1])
            else:
                own = np.zeros(0, dtype=np.uint64)
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out
