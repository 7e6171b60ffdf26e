"""Suffix arrays by induced sorting, and common prefixes in text order, in numpy."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol is the least and stands alone."""
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return np.append(step[np.minimum(nearest, len(step) - 1)] > 0, True)


def _dealt(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, ends: np.ndarray, sign: int) -> None:
    """Append positions, in order, to their buckets, which grow from `ends` in direction `sign`."""
    order = np.argsort(chars.astype(np.uint16), kind="stable")  # a radix sort, linear
    chars, at = chars[order], at[order]
    new = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
    sizes = np.diff(np.append(new, len(chars)))
    within = np.arange(len(chars)) - np.repeat(new, sizes)
    sa[ends[chars] + sign * within] = at
    ends[chars[new]] += sign * sizes


def _induced(t: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order: larger ones from the left,
    bucket by bucket, then smaller ones from the right."""
    sizes = np.bincount(t, minlength=k)
    tops = np.cumsum(sizes)
    sa = np.full(len(t), -1, np.int64)
    tails = tops - 1
    _dealt(sa, sorted_lms[::-1], t[sorted_lms[::-1]], tails, -1)
    heads = tops - sizes
    for c in np.flatnonzero(sizes):
        lo, seeds = heads[c] if heads[c] else tops[c] - sizes[c], sa[tails[c] + 1 : tops[c]]
        lo = tops[c] - sizes[c]
        while lo < heads[c]:
            own = sa[lo : heads[c]]
            lo = heads[c]
            own = own[own > 0] - 1
            own = own[~small[own]]
            if len(own):
                _dealt(sa, own, t[own], heads, 1)
        own = seeds[seeds > 0] - 1
        own = own[~small[own]]
        if len(own):
            _dealt(sa, own, t[own], heads, 1)
    tails = tops - 1
    for c in np.flatnonzero(sizes)[::-1]:
        hi = tops[c] - 1
        while hi > tails[c]:
            own = sa[tails[c] + 1 : hi + 1][::-1]
            hi = tails[c]
            own = own[own > 0] - 1
            own = own[small[own]]
            if len(own):
                _dealt(sa, own, t[own], tails, -1)
        own = sa[tops[c] - sizes[c] : heads[c]][::-1]
        own = own[own > 0] - 1
        own = own[small[own]]
        if len(own):
            _dealt(sa, own, t[own], tails, -1)
    return sa


def _suffixes_of_names(names: np.ndarray, k: int) -> np.ndarray:
    """The recursion. A name's alphabet has as many symbols as there are names, so buckets are tiny and are walked one
    suffix at a time; the steps are those of the level above."""
    t = names.tolist()
    n = len(t)
    small = _types(names)
    s = small.tolist()
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(names, minlength=k)
    tops = np.cumsum(sizes)

    def induced(seeds: list[int]) -> list[int]:
        sa, tails, heads = [-1] * n, (tops - 1).tolist(), (tops - sizes).tolist()
        for i in reversed(seeds):
            c = t[i]
            sa[tails[c]] = i
            tails[c] -= 1
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not s[j]:
                c = t[j]
                sa[heads[c]] = j
                heads[c] += 1
        tails = (tops - 1).tolist()
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and s[j]:
                c = t[j]
                sa[tails[c]] = j
                tails[c] -= 1
        return sa

    if not len(lms):
        return np.array(induced([]), np.int64)
    return np.array(induced(_sorted_lms(names, lms, np.array(induced(lms.tolist()), np.int64)).tolist()), np.int64)


FACTOR = 0x9E3779B97F4A7C15


def _powers(n: int, factor: int = FACTOR) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(factor))]))


def _hashes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers from which the hash of any stretch follows."""
    symbol = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    symbol ^= symbol >> np.uint64(32)
    power = _powers(len(t))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbol * power[:-1])]), power


def _sorted_lms(t: np.ndarray, lms: np.ndarray, rough: np.ndarray) -> np.ndarray:
    """The leftmost-smaller suffixes in order. rough: suffixes induced from them unsorted, which sorts their substrings."""
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    ends = np.append(lms[1:] + 1, len(t))
    sums, power = _hashes(t)
    at = np.searchsorted(lms, order)
    length = (ends - lms)[at]
    own = (sums[ends[at]] - sums[order]) * power[len(t) - order]  # shifted to a common place
    new = np.append(True, (length[1:] != length[:-1]) | (own[1:] != own[:-1]))
    name = np.empty(len(lms), np.int64)
    name[at] = np.cumsum(new) - 1
    if new.all():
        return order
    return lms[_suffixes_of_names(name, int(new.sum()))]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of a text's suffixes in order. text: small numbers; the last is less than all others."""
    t = text.astype(np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    k = int(t.max()) + 1
    return _induced(t, small, _sorted_lms(t, lms, _induced(t, small, lms, k)), k)


def prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of the text, how many symbols its suffix shares with the one before it in order, before either
    meets a separator (symbols 0 and 1). These are permuted common prefixes: where the suffixes one place to the left
    agree in their first symbol, the value is one less than theirs; only the others are compared, symbol by symbol."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.append(0, text[:-1])
    own = np.flatnonzero((before < 0) | (left <= 1) | (left != left[before]))  # all others follow from these
    stops = np.append(np.flatnonzero(text <= 1), n)
    here, there = own[before[own] >= 0], before[own[before[own] >= 0]]
    room = np.minimum(stops[np.searchsorted(stops, here)] - here, stops[np.searchsorted(stops, there)] - there)
    packed = np.append(text, np.zeros(4, text.dtype)).astype(np.uint64)
    packed = packed[:n] | packed[1 : n + 1] << np.uint64(16) | packed[2 : n + 2] << np.uint64(32) | packed[3 : n + 3] << np.uint64(48)
    shared, active = np.zeros(len(here), np.int64), np.arange(len(here))
    for values, step in ((packed, 4), (text, 1)):
        active = np.arange(len(here))
        while len(active):
            done = shared[active]
            active = active[done + step <= room[active]]
            done = shared[active]
            active = active[values[here[active] + done] == values[there[active] + done]]
            shared[active] += step
    value = np.zeros(n, np.int64)
    value[here] = shared
    root = np.zeros(n, np.int64)
    root[own] = own
    root = np.maximum.accumulate(root)
    return value[root] - (np.arange(n) - root)
