"""Canonical, length-limited Huffman coding of number sequences, vectorised with numpy."""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints of a block.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Code length per symbol by package-merge, none above ``limit``; 0 for unused symbols.

    The limit is raised where the used symbols are too many for it.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # Level by level, singles and pairs of the level below are merged by weight.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < n)
        merged = merged[by_weight]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for single in reversed(levels):
        singles = int(single[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


class Code:
    """Encoder and table-driven decoder of one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(lengths.max(initial=1)))
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        #: Canonical: by length, then symbol; each code fills a range of the decoding table.
        spans = 1 << (self.width - self.lengths[order])
        starts = np.concatenate([[0], np.cumsum(spans)])[:-1]
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = starts >> (self.width - self.lengths[order])
        self.symbols = np.zeros(1 << self.width, np.uint32)
        self.steps = np.ones(1 << self.width, np.int64)
        filled = int(spans.sum())
        self.symbols[:filled] = np.repeat(order, spans)
        self.steps[:filled] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every ``STRIDE``-th id)."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, room = starts >> 5, 64 - (starts & 31) - sizes
        # A code of at most 32 bits lies in the 64 bits from its 32-bit word on.
        placed = self.codes[ids] << room.astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        joined = np.bitwise_or.reduceat(placed, first)
        words = np.zeros(int(ends[-1] >> 5) + 2, np.uint32)
        words[word[first]] |= (joined >> np.uint64(32)).astype(np.uint32)
        words[word[first] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return words.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3], starts[::STRIDE]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block. All stretches between checkpoints advance together."""
        out = np.zeros((len(checkpoints), STRIDE), np.uint32)
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint64)
        at = checkpoints.astype(np.int64).copy()
        last = n - (len(checkpoints) - 1) * STRIDE
        size, mask = self.width, (1 << self.width) - 1
        for k in range(STRIDE if len(checkpoints) > 1 else n):
            if k == last:  # the last stretch is over
                at = at[:-1]
            byte, gone = at >> 3, (at & 7).astype(np.uint64)
            window = (
                data[byte] << np.uint64(32) | data[byte + 1] << np.uint64(24)
                | data[byte + 2] << np.uint64(16) | data[byte + 3] << np.uint64(8)
                | data[byte + 4]
            )
            entry = (window >> (np.uint64(40 - size) - gone)) & np.uint64(mask)
            out[: len(at), k] = self.symbols[entry]
            at = at + self.steps[entry]
        return out.ravel()[:n]
