"""Spanning forests over arrays of links."""

from __future__ import annotations

import numpy as np


class Forest:
    """Keeps of many links only those that join what was apart: fewer than there are rows."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the links that join two trees; each tree hangs itself under one lower one at a time."""
        left = np.flatnonzero(self.root[a] != self.root[b])
        kept = []
        while len(left):
            x, y = self.root[a[left]], self.root[b[left]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = np.ones(len(order), bool)
            first[1:] = high[order][1:] != high[order][:-1]
            chosen = order[first]
            self.root[high[chosen]] = low[chosen]
            kept.append(left[chosen])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            left = left[self.root[a[left]] != self.root[b[left]]]
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return a[kept], b[kept]
