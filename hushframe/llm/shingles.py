"""Sets of word shingles as sorted arrays of 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACE] = 0
_PLACE = _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 22
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the 0, 1 .. n-1 modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word (a run without white space) of UTF-8 bytes."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data):  # a block ends behind white space
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if not len(gaps):
                later = np.flatnonzero(_SPACE[data[end:]])
                gaps = [end - at + later[0]] if len(later) else [len(data) - at - 1]
            end = at + int(gaps[-1]) + 1
        block = data[at:end]
        space = _SPACE[block]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            values = _BYTE[block] * _power(_BASE, len(block))
            hashes.append(mixed(np.add.reduceat(values, starts) * _power(_BASE_INVERSE, len(block))[starts]))
            firsts.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text (UTF-8) its distinct shingles of WORDS words, A-Z lower-cased; a shorter text is one shingle, one without words has none."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join(parts).lower(), dtype=np.uint8)
    words, firsts = word_hashes(data)
    ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.concatenate(([0], np.searchsorted(firsts, ends))).tolist()
    n = len(words) - WORDS + 1
    whole = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(WORDS if n > 0 else 0):
        whole += words[k : k + n] * _PLACE[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= WORDS:
            own = np.sort(whole[a : b - WORDS + 1])
            keep = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            few = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([few], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
