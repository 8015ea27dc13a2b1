"""Signature trees over sets: nodes hold the OR of their members' token bitmaps and the range of their sizes.

Two nodes are searched together only if the overlap that their bitmaps and sizes allow can reach the threshold. A set with n tokens
has a bitmap of at least 1.25 n bits (a power of two); bitmaps of neighbouring widths are compared after folding the wider one.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
LEAST_BITS = 256
_CHUNK = 1 << 22


def bits_for(n: int) -> int:
    return max(LEAST_BITS, 1 << (5 * n // 4).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    width = bits_for(len(tokens))
    flags = np.zeros(width, np.uint8)
    flags[tokens.view(np.uint64) & np.uint64(width - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted distinct tokens."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= int(needed(np.int64(len(a)), np.int64(len(b)), percent))


class _Level:
    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, extra: np.ndarray):
        self.bits, self.low, self.high, self.extra = bits, low, high, extra

    def parents(self) -> _Level:
        cuts = np.arange(0, len(self.low), FANOUT)
        return _Level(np.bitwise_or.reduceat(self.bits, cuts, axis=0), np.minimum.reduceat(self.low, cuts), np.maximum.reduceat(self.high, cuts), np.maximum.reduceat(self.extra, cuts))

    def keep(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that can hold a link, with the largest overlap that is possible for them."""
        ok = (100 * self.high[i] >= percent * self.low[j]) & (100 * self.high[j] >= percent * self.low[i])
        i, j = i[ok], j[ok]
        most = np.empty(len(i), np.int64)
        step = max(1, _CHUNK // self.bits.shape[1])
        for a in range(0, len(i), step):
            both = self.bits[i[a : a + step]] & self.bits[j[a : a + step]]
            most[a : a + step] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        most = np.minimum(most + np.minimum(self.extra[i], self.extra[j]), np.minimum(self.high[i], self.high[j]))
        ok = most >= needed(self.low[i], self.low[j], percent)
        return i[ok], j[ok], most[ok]


def _candidates(bits: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal of one tree with itself; members come in order of size."""
    levels = [_Level(bits, n, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1].low) > FANOUT:
        levels.append(levels[-1].parents())
    i, j = np.triu_indices(len(levels[-1].low), 1 if len(levels) == 1 else 0)
    for depth in range(len(levels) - 1, -1, -1):
        i, j, most = levels[depth].keep(i, j, percent)
        if not depth:
            return i, j, most
        m = len(levels[depth - 1].low)
        grid = np.arange(FANOUT)
        i, j = (i[:, None, None] * FANOUT + grid[:, None] + 0 * grid).ravel(), (j[:, None, None] * FANOUT + 0 * grid[:, None] + grid).ravel()
        ok = (i < j if depth == 1 else i <= j) & (j < m)
        i, j = i[ok], j[ok]
    raise AssertionError


def links(n: np.ndarray, maps: list[bytes], labels: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect the given labels: a spanning forest of all pairs that may link (or do, if sets are given).

    Members of one label count as connected. Every pair that could link is looked at unless its ends are connected by then.
    """
    codes = np.unique(labels, return_inverse=True)[1]
    if not len(codes) or codes.max() == 0:
        return []
    parent = list(range(int(codes.max()) + 1))
    left = len(parent) - 1

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    widths = np.array([8 * len(m) for m in maps])
    out = []
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(at) < 2:
            continue
        at = at[np.lexsort((codes[at], n[at]))]
        words = width // 64
        bits = np.empty((len(at), words), np.uint64)
        for r, k in enumerate(at):
            m = np.frombuffer(maps[k], np.uint64)
            bits[r] = m if len(m) == words else m[:words] | m[words:]
        i, j, most = _candidates(bits, n[at], percent)
        ok = (codes[at[i]] != codes[at[j]]) & ((widths[at[i]] == width) | (widths[at[j]] == width))
        i, j, most = at[i[ok]], at[j[ok]], most[ok]
        order = np.argsort(-(most / (n[i] + n[j])), kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = root(int(codes[a])), root(int(codes[b]))
            if x != y and (sets is None or similar(sets[a], sets[b], percent)):
                parent[x] = y
                out.append((a, b))
                left -= 1
                if not left:
                    return out
    return out
