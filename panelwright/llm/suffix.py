"""Suffix arrays of one batch in numpy: prefix doubling, common prefixes, earlier matches."""

from __future__ import annotations

import numpy as np


def dense_ranks(codes: np.ndarray) -> np.ndarray:
    """Rank of every code; equal codes share the index of the first of them in sorted order."""
    order = np.argsort(codes)
    sorted_codes = codes[order]
    new = np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])) if len(codes) else np.zeros(0, bool)
    ranks = np.empty(len(codes), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    return ranks


def double(ranks: np.ndarray, step: int) -> np.ndarray:
    """Ranks by the first 2 * ``step`` symbols from those by the first ``step``.

    Only suffixes that are still tied are sorted.
    """
    n = len(ranks)
    tied = np.flatnonzero(np.bincount(ranks, minlength=n)[ranks] > 1)
    out = ranks.copy()
    if not len(tied):
        return out
    after = tied + step
    second = np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
    key = ranks[tied] * (n + 1) + second
    order = np.argsort(key)
    key = key[order]
    first = key // (n + 1)
    at = np.arange(len(tied))
    new_bucket = np.concatenate(([True], first[1:] != first[:-1]))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    bucket_start = np.maximum.accumulate(np.where(new_bucket, at, 0))
    out[tied[order]] = first + np.maximum.accumulate(np.where(new, at, 0)) - bucket_start
    return out


def levels(first: np.ndarray, length: int, depth: int | None = None) -> list[tuple[int, np.ndarray]]:
    """Ranks by prefixes of ``length``, 2 * ``length``, ... symbols, until ``depth`` or until no two are tied."""
    out = [(length, first)]
    while (depth is None or out[-1][0] < depth) and len(first) and np.bincount(out[-1][1]).max() > 1:
        n, ranks = out[-1]
        out.append((2 * n, double(ranks, n)))
    return out


def common_prefix(ranked: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols that suffixes ``i`` and ``j`` share, in steps of the lowest level and up to twice the highest less one."""
    n = len(ranked[0][1])
    shared = np.zeros(len(i), np.int64)
    for length, ranks in reversed(ranked):
        a, b = i + shared, j + shared
        inside = np.maximum(a, b) < n
        shared += length * (inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]))
    return shared


def longest_previous(sa: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest-previous-factor array: for each suffix the longest match that starts earlier.

    ``lcp[r]`` belongs to ``sa[r - 1]`` and ``sa[r]``. The earlier match is the previous or the next
    smaller position in suffix order; both are found by pointer jumping. Values below ``least`` are
    not told apart from 0.
    """
    n = len(sa)
    best = np.zeros(n, np.int64)
    for backwards in (False, True):
        pos = sa[::-1] if backwards else sa
        shared = np.concatenate(([0], lcp[1:]))
        if backwards:
            shared = np.concatenate(([0], lcp[:0:-1]))
        to = np.arange(n) - 1
        shared = shared.copy()
        active = np.flatnonzero((to >= 0) & (shared >= least))
        active = active[pos[to[active]] > pos[active]]
        while len(active):
            via = to[active]
            shared[active] = np.minimum(shared[active], shared[via])
            to[active] = to[via]
            active = active[(shared[active] >= least) & (to[active] >= 0)]
            active = active[pos[to[active]] > pos[active]]
        found = np.where((to >= 0) & (shared >= least), shared, 0)
        best[pos] = np.maximum(best[pos], found)
    return best


def union_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted spans; touching spans are one run."""
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return start[first], reach[np.concatenate((first[1:] - 1, [len(start) - 1]))]
