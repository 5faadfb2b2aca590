"""Anchors: for every window of a text a position that depends on the window's bytes alone.

The anchor of a window is its leftmost k-byte gram of the smallest hash.  Equal windows have equal
anchors, so all occurrences of a window meet under its anchor's hash.  Neighbouring windows mostly
share their anchor; a run of them is one row.
"""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
# Window starts handled at once; positions take the low bits of the packed hashes.
CHUNK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_MULTIPLY = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB)
    size = 1
    for multiply in _MULTIPLY:
        h = h[:-size] * multiply + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_runs(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one anchor: hash and place of the anchor, first window, last window."""
    keys, places, firsts, lasts = [], [], [], []
    for begin in range(0, len(text) - window + 1, CHUNK):
        data = np.frombuffer(text, dtype=np.uint8, count=min(CHUNK + window - 1, len(text) - begin), offset=begin)
        h = gram_hashes(data)
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(packed, window - GRAM + 1) & _PLACE).astype(np.int64)
        turns = np.flatnonzero(place[1:] != place[:-1])
        first = np.concatenate(([0], turns + 1))
        keys.append(h[place[first]].view(np.int64))
        places.append(place[first] + begin)
        firsts.append(first + begin)
        lasts.append(np.concatenate((turns, [len(place) - 1])) + begin)
    if not keys:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    return np.concatenate(keys), np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)


def stretch_hashes(text: bytes, firsts: np.ndarray, lasts: np.ndarray, window: int) -> np.ndarray:
    """A hash of the bytes that each run of windows covers."""
    hashes = [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(firsts.tolist(), (lasts + window).tolist())]
    return np.array(hashes, dtype=np.uint64).view(np.int64) ^ np.int64(-1 << 63)
