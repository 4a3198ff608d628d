"""Words of a byte array as numbers of an exact dictionary, in numpy and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._arrays import _LETTER, _POWERS, mix


def byte_set(*parts) -> np.ndarray:
    """Which of the 256 bytes belong to any of ``parts`` (ranges or bytes)."""
    out = np.zeros(256, bool)
    for part in parts:
        out[list(part)] = True
    return out


def tokens(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``(starts, ends, ids, words)``: each run of word bytes and its number in the distinct ``words``."""
    mask = is_word[raw]
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(raw[mask])])
    coded = runs.dictionary_encode()
    return starts, ends, coded.indices.to_numpy(), coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, none of which is empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sizes = np.diff(at)
    letters = _LETTER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    first = at[:-1] - at[0]
    place = np.arange(letters.size) - np.repeat(first, sizes)
    return mix(np.add.reduceat(letters * _POWERS[place & 1023], first) + sizes.astype(np.uint64))
