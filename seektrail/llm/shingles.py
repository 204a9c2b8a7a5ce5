"""Word shingles of whole texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

from seektrail.llm.common import mix

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C55)
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def words(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, A-Z lower-cased, and the n + 1 limits of each text's words.

    Words are runs of bytes other than the space and tab to carriage return; none crosses a text.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(limits), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = limits[(limits > 0) & (limits < len(data))]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(limits), np.int64)
    kept = np.flatnonzero(inside)
    letters = _LOWER[data[kept]]
    starts = np.searchsorted(kept, at)
    place = np.arange(len(kept)) - np.repeat(starts, np.diff(starts, append=len(kept)))
    powers = np.full(int(place.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    hashes = np.add.reduceat(_BYTES[letters] * powers[place], starts)
    return mix(hashes), np.searchsorted(at, limits)


def shingle_sets(
    data: np.ndarray, limits: np.ndarray, size: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their n + 1 limits.

    A text with fewer than `size` words has its whole word sequence as one shingle.
    """
    hashes, word_limits = words(data, limits)
    sets = []
    full = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        full += hashes[k : k + len(full)] * _PLACES[k]
    full = mix(full)
    for a, b in zip(word_limits[:-1], word_limits[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            whole = (hashes[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)
            sets.append(mix(np.array([whole])))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else full[:0], np.concatenate([[0], np.cumsum(sizes)])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
