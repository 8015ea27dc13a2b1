"""Distinct word shingles of texts as 64-bit hashes, computed on the bytes of whole Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from touchline.llm.common import mix, slices, utf8

_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)[_LOWER]
_POSITION = mix((np.arange(64, dtype=np.uint64) + np.uint64(1001)) * _BASE) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * _SLICE)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + 4 * _SLICE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _power(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _POSITION[63])
        a = b
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its k-word shingles; the whole sequence as one if it has fewer words."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, _SLICE):
        lo, hi = int(offsets[a]), int(offsets[b])
        part, offs = data[lo:hi], offsets[a : b + 1] - lo
        word = ~_SPACE[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[offs] = True
        before = np.empty(len(part), bool)
        before[:1] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.empty(len(part), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        hashes = _word_hashes(part, starts, ends)
        first = np.searchsorted(starts, offs)
        if len(hashes) >= k:
            rolled = hashes[: len(hashes) - k + 1] * _POSITION[0]
            for j in range(1, k):
                rolled = rolled + hashes[j : len(hashes) - k + 1 + j] * _POSITION[j]
            rolled = mix(rolled).view(np.int64)
        for i in range(b - a):
            f, t = int(first[i]), int(first[i + 1])
            if t - f >= k:
                yield np.unique(rolled[f : t - k + 1])
            elif t > f:
                short = (hashes[f:t] * _POSITION[: t - f]).sum(dtype=np.uint64) + np.uint64(t - f)
                yield mix(np.array([short])).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
