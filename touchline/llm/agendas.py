"""Merges of the parts of many words side by side, best rank first and leftmost among equals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

WIDTHS = (4, 6, 8, 10, 12, 16, 24, 40, 64)  # words of up to so many characters share a table; longer ones go another way
ROWS = 8192  # words of a table
_NONE = np.iinfo(np.int32).max  # rank where there is no candidate


class Numbers:
    """Numbers by 64-bit keys other than 0; many keys are found at once (open addressing)."""

    def __init__(self, room: int):
        bits = max(room, 1).bit_length() + 2
        self.n, self.room, self.shift, self.last = 0, room, np.uint64(64 - bits), (1 << bits) - 1
        self.held, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those not held."""
        slots = self._slots(keys)
        held = self.held[slots]
        same = held == keys
        out = np.where(same, self.number[slots], np.int32(-1))
        more = np.flatnonzero(~same & (held != 0))
        while len(more):
            slots[more] = slots[more] + 1 & self.last
            at, wanted = slots[more], keys[more]
            held = self.held[at]
            same = held == wanted
            out[more[same]] = self.number[at[same]]
            more = more[~same & (held != 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Keys that differ and are not held, `room` in all at most; numbers are not negative."""
        if self.n + len(keys) > self.room:
            raise ValueError(f"more than {self.room} keys")
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.held[slots[left]] == 0]
            self.held[slots[free]] = keys[free]
            mine = self.held[slots[left]] == keys[left]
            self.number[slots[left[mine]]] = numbers[left[mine]]
            left = left[~mine]
            slots[left] = slots[left] + 1 & self.last
        self.n += len(keys)


def tables(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Widths of tables and the words in each; words longer than the widest are left out."""
    for shorter, width in zip((0, *WIDTHS), WIDTHS):
        every = np.flatnonzero((lengths > shorter) & (lengths <= width))
        for a in range(0, len(every), ROWS):
            yield width, every[a : a + ROWS]


class Agendas:
    """Pairs of parts (numbers from 1, below `span`) that are a part together, with its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, whole: np.ndarray, span: int):
        self.span = np.uint64(span)
        self.pairs = Numbers(len(left))
        self.pairs.add(left.astype(np.uint64) * self.span + right.astype(np.uint64), np.arange(len(left)))
        self.rank, self.whole = np.append(rank, _NONE).astype(np.int32), np.append(whole, 0).astype(np.int32)  # the last, -1, for no pair

    def run(self, table: np.ndarray, gap: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Parts that are left of each word, a row each, with 0 where none starts.

        A row of `table` holds the parts of a word between zeros, one at least on both sides. Each place has the part that starts there,
        the places of the parts before and after, and the rank and the part of its candidate, the merge with the part after. `gap` gives
        how many candidates of a row are taken before its next one is skipped, by row and count of its skips.
        """
        n, wide = table.shape
        parts = table.astype(np.int32).ravel()
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)
        rank, whole = np.full(n * wide, _NONE, np.int32), np.zeros(n * wide, np.int32)
        at = np.flatnonzero((parts[:-1] > 0) & (parts[1:] > 0))
        self._candidates(parts, rank, whole, at, at + 1)
        rows, agenda = np.arange(n), rank.reshape(n, wide)
        if gap is not None:
            since, skips = np.zeros(n, np.int64), np.zeros(n, np.int64)
            gaps = gap(rows, skips)
        while len(rows):
            at = rows * wide + agenda[rows].argmin(1)
            live = rank[at] < _NONE
            rows, at = rows[live], at[live]
            if gap is not None:
                skip = since[rows] == gaps[rows]
                since[rows] += 1
                out = rows[skip]
                if len(out):
                    rank[at[skip]] = _NONE
                    at = at[~skip]
                    since[out] = 0
                    skips[out] += 1
                    gaps[out] = gap(out, skips[out])
            middle, first = after[at], before[at]
            end = after[middle]
            parts[at], parts[middle] = whole[at], 0
            rank[middle] = _NONE
            after[at], before[end] = end, at
            self._candidates(parts, rank, whole, np.concatenate([first, at]), np.concatenate([at, end]))
        return parts.reshape(n, wide)

    def _candidates(self, parts: np.ndarray, rank: np.ndarray, whole: np.ndarray, at: np.ndarray, after: np.ndarray) -> None:
        found = self.pairs.find(parts[at].astype(np.uint64) * self.span + parts[after].astype(np.uint64))
        rank[at], whole[at] = self.rank[found], self.whole[found]
