"""Suffix arrays by two-stage sorting, and common prefixes of neighbours, on numpy arrays of bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number in byte order; zeros behind the end."""
    x = np.zeros(len(text) + 8, U)
    x[: len(text)] = text
    for k in (1, 2, 4):
        x = (x[:-k] << U(8 * k)) | x[k:]
    return x[: len(text)]


def _directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` bytes from there on: by eight bytes, then ties by the next eight."""
    key = words8(text)
    at = lambda p, d: np.where(p + d < len(key), key[np.minimum(p + d, len(key) - 1)], 0)
    order = places[np.argsort(at(places, 0))]
    first = at(order, 0)
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(order) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))
        if not len(tied):
            break
        deeper, same = at(order[tied], d), group[tied]
        splits = np.zeros(group[-1] + 1, bool)  # groups whose next eight bytes are not all equal
        splits[same[1:][(deeper[1:] != deeper[:-1]) & (same[1:] == same[:-1])]] = True
        on = splits[same]
        tied, deeper, same = tied[on], deeper[on], same[on]
        if not len(tied):
            continue
        own, rank = order[tied], np.lexsort((deeper, same))
        order[tied] = own[rank]
        deeper = deeper[rank]  # groups keep their places
        new[tied[1:]] |= (deeper[1:] != deeper[:-1]) & (same[1:] == same[:-1])
    return order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes, sorted by at least their first ``depth`` bytes.

    Only suffixes smaller than their successor are sorted directly. Every other one is larger than its successor, so
    its place follows from the successor's: buckets of the first byte are scanned in order, and the predecessor of each
    suffix passed is put at the end of the larger ones of its own bucket. A bucket's scan adds to the bucket itself
    where a byte repeats; that goes in waves.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])  # the last place of each run of one byte
    ends = np.concatenate([change, [n - 1]])
    rising = np.concatenate([text[change + 1] > text[change], [False]])  # the empty suffix is smallest
    smaller = np.repeat(rising, np.diff(np.concatenate([[-1], ends])))
    direct = _directly(text, np.flatnonzero(smaller), depth)
    bucket = text[direct]
    direct_at = np.searchsorted(bucket, np.arange(257))

    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        passed = []
        while len(wave):
            passed.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]  # one byte, one kind: these are larger than their successor, too
        passed.append(direct[direct_at[c] : direct_at[c + 1]])
        own = np.concatenate(passed)
        out.append(own)
        before = own[own > 0] - 1
        before = before[~smaller[before] & (text[before] != c)]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            kinds, at = np.unique(first, return_index=True)
            for kind, part in zip(kinds, np.split(before, at[1:]), strict=True):
                pending[kind].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common bytes of each suffix in the order with the one before it, up to ``depth``; 0 for the first."""
    key = words8(text)
    out = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for d in range(0, depth, 8):
        a, b = order[active] + d, order[active - 1] + d
        differ = np.where(a < len(key), key[np.minimum(a, len(key) - 1)], 0) ^ np.where(b < len(key), key[np.minimum(b, len(key) - 1)], 0)
        equal = differ == 0
        rest = differ[~equal]
        out[active[~equal]] += 7 - sum((rest >= U(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        active = active[equal]
        out[active] += 8
        if not len(active):
            break
    return np.minimum(np.minimum(out, depth), np.minimum(len(text) - order, len(text) - np.concatenate([order[:1], order[:-1]])))
