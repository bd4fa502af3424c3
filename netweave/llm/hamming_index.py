"""A hierarchical index over 64-bit codes in Gray order.

Codes are sorted by Gray rank, so neighbours share most bits. Each node covers
``FANOUT`` consecutive children; it holds the bits on which all codes below it
agree (a mask and a value), less those that its parent already holds. A search
goes down level by level, adds up the differences found in each node's own
bits, and drops a whole group as soon as the sum exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index of distinct codes; ``codes`` are in Gray order."""

    def __init__(self, codes: np.ndarray):
        codes = np.asarray(codes, dtype=np.uint64)
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        masks, values = np.full(len(codes), ALL), self.codes
        levels = [(masks, values)]
        while len(values) > 1:
            starts = np.arange(0, len(values), FANOUT)
            first = np.repeat(values[starts], np.diff(np.append(starts, len(values))))
            differ = np.bitwise_or.reduceat(values ^ first, starts)
            masks = np.bitwise_and.reduceat(masks, starts) & ~differ
            values = values[starts] & masks
            levels.append((masks, values))
        # From the top: each node keeps the bits that its parent does not hold.
        self.levels = []
        for depth in range(len(levels) - 1, -1, -1):
            masks, values = levels[depth]
            if depth + 1 < len(levels):
                above = np.repeat(levels[depth + 1][0], FANOUT)[: len(masks)]
                masks = masks & ~above
            self.levels.append((masks, values & masks))

    def search(self, queries: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in queries, position in ``codes``) at ``radius`` or less, block by block."""
        queries = np.asarray(queries, dtype=np.uint64)
        for at in range(0, len(queries), block):
            part = queries[at : at + block]
            who = np.arange(len(part))
            node = np.zeros(len(part), dtype=np.int64)
            far = np.zeros(len(part), dtype=np.uint8)
            for depth, (masks, values) in enumerate(self.levels):
                if depth:
                    who, far = np.repeat(who, FANOUT), np.repeat(far, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < len(masks)
                    who, far, node = who[there], far[there], node[there]
                far = far + np.bitwise_count((part[who] ^ values[node]) & masks[node])
                near = far <= radius
                who, far, node = who[near], far[near], node[near]
            yield who + at, node


def spanning_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the codes which chains of steps of ``radius`` or less connect.

    At most one link for each code, never all pairs: each code that is not the
    first of its set is linked to the first.
    """
    index = GrayIndex(codes)
    parent = np.arange(len(index.codes))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    for a, b in index.search(index.codes, radius):
        keep = a < b
        a, b = a[keep], b[keep]
        while len(a):
            a, b = root(a), root(b)
            keep = a != b
            a, b = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
            np.minimum.at(parent, b, a)
    top = root(np.arange(len(parent)))
    linked = np.flatnonzero(top != np.arange(len(parent)))
    return index.codes[linked], index.codes[top[linked]]
