"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np


def _place(order: np.ndarray, found: np.ndarray, letters: np.ndarray, at: np.ndarray, step: int):
    """Append positions to their buckets in the given order; `at` moves by `step` (1 or -1)."""
    by = np.argsort(letters, kind="stable")
    letters, found = letters[by], found[by]
    counts = np.bincount(letters, minlength=len(at))
    first = np.cumsum(counts) - counts
    order[at[letters] + step * (np.arange(len(letters)) - first[letters])] = found
    at += step * counts


def _induce(text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, starts: np.ndarray):
    """All suffixes in order, given the leftmost-smaller ones (`starts`) in order.

    A bucket holds the suffixes with one first letter: larger ones (those that precede their
    right neighbour) first, then smaller ones. Larger suffixes are induced through the buckets upwards,
    smaller ones downwards, a bucket's suffixes at a time.
    """
    order = np.full(len(text), -1, np.int32)
    letters = text[starts]
    first = np.searchsorted(letters, np.arange(len(heads)))
    ends = np.append(heads[1:], len(text))
    left = heads.copy()
    for c in range(len(heads)):
        done = heads[c]
        while done < left[c]:
            batch = order[done : left[c]] - 1
            done = left[c]
            batch = batch[batch >= 0]
            batch = batch[~smaller[batch]]
            if len(batch):
                _place(order, batch, text[batch], left, 1)
        own = starts[first[c] : first[c + 1] if c + 1 < len(first) else None] - 1
        own = own[own >= 0]
        if len(own):
            _place(order, own, text[own], left, 1)
    right = ends - 1
    order[0] = len(text) - 1
    right[0] -= 1 if len(heads) else 0
    for c in range(len(heads) - 1, -1, -1):
        done = ends[c] - 1
        while done > right[c]:
            batch = order[right[c] + 1 : done + 1][::-1] - 1
            done = right[c]
            batch = batch[batch >= 0]
            batch = batch[smaller[batch]]
            if len(batch):
                _place(order, batch, text[batch], right, -1)
        batch = order[heads[c] : left[c]][::-1] - 1
        batch = batch[batch >= 0]
        batch = batch[smaller[batch]]
        if len(batch):
            _place(order, batch, text[batch], right, -1)
    return order


def _ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, each pair of names being named anew.

    Only suffixes that are still tied are sorted again. (Inducing bucket by bucket, as for letters,
    would take a step per name here, and there are about as many names as places.)
    """
    order = np.argsort(names, kind="stable")
    n, reach = len(names), 1
    ordered = names[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(tied):
        who = order[tied]
        later = np.where(who + reach < n, rank[np.minimum(who + reach, n - 1)] + 1, 0)
        group = rank[who]
        by = np.lexsort((later, group))
        who, later, group = who[by], later[by], group[by]
        order[tied] = who
        new = np.r_[True, (group[1:] != group[:-1]) | (later[1:] != later[:-1])]
        rank[who] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        reach *= 2
    return order


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(
        padded.view(), (len(data), 8), (1, 1)
    ).copy().view(np.uint64).ravel()


def _common(words: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b (a <> b, neither past the end)."""
    n, out = len(data), np.zeros(len(a), np.int64)
    left = n - np.maximum(a, b)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = words[x] ^ words[y]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) // 8)
        out[live] += same
        over = out[live] >= left[live]
        out[live] = np.minimum(out[live], left[live])
        live = live[(differ == 0) & ~over]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of the suffixes of a byte array in lexical order.

    Suffixes are classified as smaller or larger than their right neighbour. The leftmost-smaller
    substrings are sorted by one induced pass and named; the string of their names is sorted;
    a second induced pass sorts all suffixes from it.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    used = np.unique(data)
    code = np.zeros(256, np.int16)
    code[used] = np.arange(1, len(used) + 1)
    text = np.append(code[data], np.int16(0))
    rise = text[:-1] < text[1:]
    unequal = np.flatnonzero(text[:-1] != text[1:])
    decides = unequal[np.searchsorted(unequal, np.arange(n))]
    smaller = np.append(rise[decides], True)
    del decides, unequal
    starts = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    counts = np.bincount(text)
    heads = np.cumsum(counts) - counts
    order = _induce(text, smaller, heads, starts[np.argsort(text[starts], kind="stable")])
    is_start = np.zeros(n + 1, bool)
    is_start[starts] = True
    ordered = order[is_start[order]]
    length = np.zeros(n + 1, np.int32)
    length[starts[:-1]] = np.diff(starts) + 1
    same = np.zeros(len(ordered), bool)
    pair = np.flatnonzero(
        (length[ordered[1:]] == length[ordered[:-1]])
        & (length[ordered[1:]] > 0)
        & (np.maximum(ordered[1:], ordered[:-1]) < n)
    )
    a, b = ordered[pair], ordered[pair + 1]
    words = eights(data)
    live, at = np.arange(len(pair)), 0
    while len(live):
        need = np.minimum(length[a[live]] - at, 8)
        inside = np.maximum(a[live], b[live]) + at < n
        x, y = np.minimum(a[live] + at, n - 1), np.minimum(b[live] + at, n - 1)
        differ = (words[x] ^ words[y]) << ((8 - need) * 8).astype(np.uint64)
        fine = (differ == 0) & inside & (np.maximum(a[live], b[live]) + at + need <= n)
        done = fine & (length[a[live]] <= at + 8)
        same[pair[live[done]] + 1] = True
        live = live[fine & ~done]
        at += 8
    name = np.empty(n + 1, np.int32)
    name[ordered] = np.cumsum(~same)
    names = name[starts]
    by = _ranked(names) if same.any() else np.argsort(names)
    return _induce(text, smaller, heads, starts[by])[1:]


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every place, the common prefix with the suffix before it in order (0 for the first).

    In text order a value is at least the previous one minus 1, and just that where the letters
    before the two suffixes agree. Only the others are compared.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    place = np.arange(n, dtype=np.int32)
    reducible = (place > 0) & (before > 0)
    reducible[reducible] &= data[place[reducible] - 1] == data[before[reducible] - 1]
    own = np.flatnonzero(~reducible)
    value = np.zeros(len(own), np.int64)
    real = before[own] >= 0
    value[real] = _common(eights(data), data, own[real], before[own[real]])
    last = np.cumsum(~reducible) - 1
    return np.maximum(value[last] - (place - own[last]), 0)
