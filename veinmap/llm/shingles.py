"""Sets of five-word shingles of whole texts, as sorted 64-bit hashes, computed on the bytes of an Arrow array.

Words are lower-cased (A-Z) runs without ASCII white space. A word's hash is a polynomial over
random 64-bit values of its bytes, taken from prefix sums; such a polynomial modulo 2^64 can't tell some words of a
thousand letters and more apart, whatever its constants, so words over ``LONG_WORD`` bytes get a keyed digest each. Everything is a function of the word's bytes alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
LONG_WORD = 256
SPAN = 1 << 20

_RNG = np.random.default_rng(77_003)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9D2C5680F1A3B7C5
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        n = SPAN + LONG_WORD + 1
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word data[start:end], in order of their starts."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    at = 0
    while at < len(starts):
        if sizes[at] > LONG_WORD:
            word = _LOWER[data[starts[at] : ends[at]]].tobytes()
            out[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"long word").digest(), "little")
            at += 1
            continue
        first = int(starts[at])
        stop = int(np.searchsorted(starts, first + SPAN, "right"))
        wide = np.flatnonzero(sizes[at:stop] > LONG_WORD)
        if len(wide):
            stop = at + int(wide[0])
        last = int(ends[stop - 1])
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[data[first:last]] * up[: last - first], out=total[1:])
        a, b = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (total[b] - total[a]) * down[a]
        at = stop
    return mix(out + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than SHINGLE count as one, none as the empty set."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    empty = np.zeros(0, np.uint64)
    if n == 0 or offsets[-1] == offsets[0]:
        return [empty] * n
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~word[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    h = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    k = np.uint64(0xD6E8FEB86659FD93)
    if len(h) >= SHINGLE:
        s = h[: len(h) - SHINGLE + 1].copy()
        for j in range(1, SHINGLE):
            s = s * k + h[j : len(h) - SHINGLE + 1 + j]
        s = mix(s)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            v = np.array([b - a], np.uint64)
            for x in h[a:b]:
                v = mix(v * k + x)
            out.append(v)
        else:
            out.append(empty)
    return out
