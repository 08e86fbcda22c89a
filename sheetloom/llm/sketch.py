"""Fast similarity sketching: every coordinate of a set's sketch fills in expected O(t log t + n) time.

Round i hashes each element to a coordinate and a value; a coordinate keeps the least (round, value). After
as many rounds as there are coordinates, rounds are dealt to one coordinate each, so all fill whatever the
set's size. A set stops as soon as it has no empty coordinate. Two sets agree in a coordinate with
probability equal to their Jaccard similarity, and the share of agreements is concentrated about it as for
independent hash functions.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_STEP = np.uint64(0xA0761D6478BD642F)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int, seed: int = 1) -> np.ndarray:
    """A row of t 64-bit values per set of distinct 64-bit hashes. An empty set's row is all ones."""
    out = np.full((len(sets), t), _EMPTY, dtype=np.uint64)
    if not sets:
        return out
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(items):
                break
            x = mix(items + np.uint64(seed * 2 * t + i + 1) * _STEP)
            place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, owner * t + place, (np.uint64(i) << np.uint64(32)) | (x >> np.uint64(32)))
            open_ = (out == _EMPTY).any(axis=1)
            more = open_[owner]
            items, owner = items[more], owner[more]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit key per band of ``rows`` coordinates; keys of different bands differ."""
    part = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :] + np.zeros((len(sketch), 1), dtype=np.uint64)
    for j in range(rows):
        key = mix(key * _STEP + part[:, :, j])
    return key.view(np.int64)
