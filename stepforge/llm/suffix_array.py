"""Blockwise suffix sorting with a difference cover.

``v`` = 31 with the perfect difference cover {1, 5, 11, 24, 25, 27}: for any two places i and j there is a d < 31 with
both i + d and j + d in the cover sample.  Ranks of the sample alone are precomputed by doubling; a bucket of suffixes
is then sorted by its first 31 bytes, and longer ties are resolved by the sample's ranks.  So only a fifth of the
places have deep ranks, and only one block of text is in memory at a time.
"""

from __future__ import annotations

import numpy as np

V = 31
COVER = (1, 5, 11, 24, 25, 27)
_IN = np.zeros(V, bool)
_IN[list(COVER)] = True
#: [i mod v, j mod v] to the least d with (i + d) mod v and (j + d) mod v both in the cover.
SHIFT = np.array([[next(d for d in range(V) if _IN[(i + d) % V] and _IN[(j + d) % V]) for j in range(V)] for i in range(V)], np.int64)


def prefix_ranks(text: np.ndarray) -> np.ndarray:
    """Dense rank of the 31 bytes at every place (zeros follow the end)."""
    n = len(text)
    padded = np.zeros(n + 40, np.uint8)
    padded[:n] = text
    key = np.zeros(n + 32, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i : i + n + 32]
    wide = np.int64(n + 40)
    key = _dense(key)
    key = _dense(key[:-8] * wide + key[8:])
    ranks = np.zeros(n + 1, np.int32)
    ranks[:n] = _dense(key[:n] * wide + key[15 : n + 15])
    return ranks


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), np.int32)
    new[1:] = k[1:] != k[:-1]
    ranks = np.empty(len(k), np.int32)
    ranks[order] = np.cumsum(new, dtype=np.int32)
    return ranks


def cover_ranks(first: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the cover sample at 31, 62, 124, ... bytes, until ``depth``; 0 stands past the end."""
    n = len(first) - 1
    at = np.flatnonzero(np.resize(_IN, n))
    levels, step = [first], V
    while step < depth:
        r = levels[-1]
        pair = r[at] * np.int64(n + 2) + r[np.minimum(at + step, n)]
        nxt = np.zeros(n + 1, np.int32)
        nxt[at] = _dense(pair)
        levels.append(nxt)
        step *= 2
    return levels


def sort_suffixes(starts: np.ndarray, first: np.ndarray, deep: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, buckets): one bucket after another, each sorted by 31 bytes, then, in ties, by a quicksort on the cover's ranks."""
    n = len(first) - 1
    sub = np.argsort(bucket * (n + 1) + first[starts])
    order, bucket = starts[sub], bucket[sub]
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (bucket[1:] != bucket[:-1])
    group = np.cumsum(new)
    active = np.arange(len(order))
    while len(active):
        g = group[active]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(head, len(g)))
        keep = np.repeat(size > 1, size)
        active, g = active[keep], g[keep]
        if not len(active):
            break
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(head, len(g)))
        at = order[active]
        pivot = np.repeat(at[head + size // 2], size)
        d = SHIFT[at % V, pivot % V]
        side = np.sign(deep[np.minimum(at + d, n)] - deep[np.minimum(pivot + d, n)]) + 1
        index = np.repeat(np.arange(len(head)), size)
        sub = np.argsort(index * 3 + side, kind="stable")
        order[active] = at[sub]
        code = (index * 3 + side)[sub]
        group[active] = code
        active = active[side[sub] != 1]
    return order, bucket


def repeated(text: np.ndarray, starts: np.ndarray, length: int, bucket: np.ndarray | None = None) -> np.ndarray:
    """For each start (a window of ``length`` >= 62 bytes inside ``text``): whether its bytes equal another start's of its bucket.

    The cover sample's ranks are computed once for the text; buckets (ascending numbers) are then sorted with them.
    """
    bucket = np.zeros(len(starts), np.int64) if bucket is None else bucket
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    first = prefix_ranks(text)
    levels = cover_ranks(first, length)
    order, bucket = sort_suffixes(starts, first, levels[-1], bucket)
    a, b = order[:-1], order[1:]
    level = max(i for i in range(len(levels)) if V << i <= length - V + 1)
    size, d = V << level, SHIFT[a % V, b % V]
    r = levels[level]
    step = (length - size - d) // V * V
    same = (first[a] == first[b]) & (r[a + d] == r[b + d]) & (r[a + d + step] == r[b + d + step]) & (first[a + length - V] == first[b + length - V]) & (bucket[1:] == bucket[:-1])
    hit = np.zeros(len(first), bool)
    hit[a[same]] = True
    hit[b[same]] = True
    return hit[starts]
