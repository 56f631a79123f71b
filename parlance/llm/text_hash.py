"""Hashes of words and word windows of whole texts, over numpy byte buffers.

A word is a maximal run of bytes outside space and \\x09-\\x0D, which equals
``[^\\x20\\x09-\\x0D]+`` on characters, since these six never occur inside a longer
UTF-8 sequence.  Buffers are cut at white space after about a megabyte, so memory does
not follow the length of a text; only a single word longer than that is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_RANDOM = np.random.PCG64(20_240_607).random_raw(256 + 64).astype(np.uint64)
_BYTE, _STEP = _RANDOM[:256], _RANDOM[256:] | np.uint64(1)
_BASE, SEGMENT = int(_STEP[-1]), 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, SEGMENT + (1 << 16)), b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _buffer_words(buf: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a buffer that ends with a space."""
    a = np.frombuffer(buf, np.uint8)
    if lower:
        a = _LOWER[a]
    ok = ~_SPACE[a]
    edges = np.flatnonzero(ok[1:] != ok[:-1]) + 1
    if ok[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    power, inverse = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, counts, hashes): word hashes of the texts first..last-1, one behind
    the other, and the number of words of each.  Short texts share a buffer; a long one
    is hashed in pieces and comes alone."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > SEGMENT:
            parts, at, t = [], 0, texts[i]
            while at < len(t):
                gap = _GAP.search(t, min(at + SEGMENT, len(t)))
                end = gap.start() if gap else len(t)
                parts.append(_buffer_words(t[at:end] + b" ", lower)[1])
                at = end
            h = np.concatenate(parts)
            yield i, i + 1, np.array([len(h)]), h
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= SEGMENT and (size + len(texts[j]) < SEGMENT or j == i):
            size += len(texts[j]) + 1
            j += 1
        starts, h = _buffer_words(b" ".join(texts[i:j]) + b" ", lower)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        yield i, j, np.diff(np.searchsorted(starts, bounds)), h
        i = j


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words of one text (none if it has fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _STEP[j]
    return mix(out + np.uint64(n))


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted set of n-word shingles; a shorter text is one shingle, an empty one none."""
    if not len(h):
        return h
    s = np.sort(windows(h, min(n, len(h))))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
