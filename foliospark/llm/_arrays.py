"""Words and shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_CHUNK = 1 << 21
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))
_LOW_LETTER, _IS_WORD = _LETTER[_LOWER], ~_IS_SPACE
#: Powers of the base; longer words start again, their length is hashed as well.
_POWERS = np.ones(1024, np.uint64)
for _i in range(1, 1024):
    _POWERS[_i] = np.multiply(_POWERS[_i - 1], _BASE)


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.ones(raw.size + 2, np.int8)
    edge[1:-1] = _IS_SPACE[raw]
    at = np.flatnonzero(np.diff(edge))
    return at[0::2], at[1::2]


def _hash_chunk(raw: np.ndarray) -> np.ndarray:
    starts, ends = spans(raw)
    if not starts.size:
        return np.empty(0, np.uint64)
    sizes = ends - starts
    letters = _LOW_LETTER[raw[_IS_WORD[raw]]]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(letters.size) - np.repeat(first, sizes)
    return mix(np.add.reduceat(letters * _POWERS[place & 1023], first) + sizes.astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word, A-Z in lower case, in blocks so that a long text needs little memory."""
    raw = np.frombuffer(data, np.uint8)
    if raw.size <= _CHUNK:
        return _hash_chunk(raw)
    parts, at = [], 0
    while at < raw.size:
        end = min(at + _CHUNK, raw.size)
        while end < raw.size and not _IS_SPACE[raw[end]]:
            gap = np.flatnonzero(_IS_SPACE[raw[end : end + _CHUNK]])
            end = min(raw.size, end + (int(gap[0]) if gap.size else _CHUNK))
        parts.append(_hash_chunk(raw[at:end]))
        at = end
    return np.concatenate(parts)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if words.size < n:
        return np.empty(0, np.uint64)
    count = words.size - n + 1
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out + words[i : i + count]) * _BASE
    return mix(out)


def shingle_set(data: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, one without words has none."""
    words = word_hashes(data)
    if not words.size:
        return words
    return np.unique(ngram_hashes(words, min(n, words.size)))
