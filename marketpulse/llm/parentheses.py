"""A forest as balanced parentheses, with block minima of the excess for navigation."""

from __future__ import annotations

import numpy as np

BLOCK = 64
_AT_ONCE = 50_000


class Parentheses:
    """Nodes are numbered in preorder, by their opening parentheses.

    The excess at a position is the number of parentheses open after it. Minima over blocks of
    64 positions, and over pairs of these up to one, form a range min-max tree: the closing
    parenthesis of a node is the next position of lesser excess, found by a scan in its block,
    a climb to a block that goes low enough, a descent, and a scan in that block.
    """

    def __init__(self, bits: np.ndarray):
        bits = np.asarray(bits, np.int64)
        self.opens = np.flatnonzero(bits)
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        excess = np.cumsum(2 * bits - 1)
        self.size = len(bits)
        blocks = max(1, -(-self.size // BLOCK))
        high = np.iinfo(np.int64).max
        self.excess = np.full(blocks * BLOCK, high, np.int64)
        self.excess[: self.size] = excess
        self.rows = self.excess.reshape(blocks, BLOCK)
        self.minima = [self.rows.min(axis=1)]
        while len(self.minima[-1]) > 1:
            last = self.minima[-1]
            if len(last) % 2:
                last = self.minima[-1] = np.append(last, high)
            self.minima.append(last.reshape(-1, 2).min(axis=1))
        pair = np.zeros(self.size, np.int64)
        if self.size:
            pair[:-1] = bits[:-1] * (1 - bits[1:])
        self.leaf_rank = np.concatenate([[0], np.cumsum(pair)])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The position that closes each opening parenthesis ``at``."""
        parts = [self._close(at[i : i + _AT_ONCE]) for i in range(0, len(at), _AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def _close(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        own = at // BLOCK
        low = (self.rows[own] <= target[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        found = low.any(axis=1)
        out = own * BLOCK + low.argmax(axis=1)
        wait = np.flatnonzero(~found)
        node, goal = own[wait], target[wait]
        level_of = np.zeros(len(wait), np.int64)
        climbing = np.ones(len(wait), bool)
        for level, minima in enumerate(self.minima):
            right = climbing & (node % 2 == 0) & (node + 1 < len(minima))
            right[right] = minima[node[right] + 1] <= goal[right]
            node[right] += 1
            level_of[right], climbing[right] = level, False
            node[climbing] //= 2
        for level in range(len(self.minima) - 1, 0, -1):
            here = level_of == level
            left = 2 * node[here]
            go_left = self.minima[level - 1][left] <= goal[here]
            node[here] = left + ~go_left
            level_of[here] = level - 1
        out[wait] = node * BLOCK + (self.rows[node] <= goal[:, None]).argmax(axis=1)
        return out

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """For every node, the end of its subtree in preorder and its number of leaves."""
        close = self.findclose(self.opens)
        return self.rank[close], self.leaf_rank[close] - self.leaf_rank[self.opens]
