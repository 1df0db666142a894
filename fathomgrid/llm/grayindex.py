"""A hierarchical index over bit codes in Gray order, for all pairs within a Hamming radius.

Codes are sorted by Gray rank, so neighbours share most bits.  A node over ``FAN`` children keeps the
bits on which all of them agree (a mask and a pattern); a child then only accounts for the bits its
parent has not settled.  A query goes down from the top with the differences counted so far, and a
whole group falls away as soon as its shared bits alone differ too often.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Queries that go down together: bounds the frontier's memory.
CHUNK = 2048
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = codes.astype(np.uint64, copy=True)
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """``codes`` must be in the order of :func:`gray_rank`."""

    def __init__(self, codes: np.ndarray):
        pattern, mask = codes, np.full(len(codes), _ALL, np.uint64)
        self.levels = [(pattern, mask)]
        while len(pattern) > FAN:
            first = np.arange(0, len(pattern), FAN)
            head = pattern[first]
            differ = (pattern ^ np.repeat(head, FAN)[: len(pattern)]) | ~mask
            mask = ~np.bitwise_or.reduceat(differ, first)
            pattern = head & mask
            self.levels.append((pattern, mask))

    def pairs(self, radius: int, same: np.uint64 = np.uint64(0)):
        """Yields arrays (i, j), i < j, of all codes that differ in at most ``radius`` bits and in none
        of the bits ``same``."""
        codes = self.levels[0][0]
        for at in range(0, len(codes), CHUNK):
            q = np.arange(at, min(at + CHUNK, len(codes)))
            pattern, mask = self.levels[-1]
            i, node = np.repeat(q, len(pattern)), np.tile(np.arange(len(pattern)), len(q))
            settled = np.zeros(len(i), np.uint64)
            spent = np.zeros(len(i), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[depth]
                m = mask[node]
                off = (codes[i] ^ pattern[node]) & (m & ~settled)
                spent = spent + np.bitwise_count(off)
                keep = (spent <= radius) & ((off & same) == 0)
                # a group before the query has no later partner
                keep &= (node + 1) * FAN**depth - 1 > i
                i, node, spent, settled = i[keep], node[keep], spent[keep], m[keep]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    i, spent, settled = (np.repeat(x, FAN) for x in (i, spent, settled))
                    real = node < below
                    i, node, spent, settled = i[real], node[real], spent[real], settled[real]
            later = node > i
            yield i[later], node[later]


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: merges a[k] with b[k] for all k; the smallest member is the root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent
