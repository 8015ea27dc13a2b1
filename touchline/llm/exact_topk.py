"""Operator 1: exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers. A block's postings lie in segments of falling quantised impact; the scores of a chunk of queries gather
segment by segment. What is still to come is bounded by the length of the query times the length of a row's unread part. A row is
dropped only when its best possible score is below k scores that are certain; rows that are left are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.vectors import finite, search_blocks

BLOCK, CHUNK = 8192, 1024  # rows and queries of a unit
SCALE = 64
_FEW = 0.01  # share of row and query pairs at which the rest is scored exactly


def _segments(v: np.ndarray) -> list[np.ndarray]:
    """Per segment the components with that impact, others 0; segments halve the impact."""
    size, out = np.abs(v), []
    high = int(size.max(initial=0))
    while high:
        low = high // 2
        out.append(np.where((size > low) & (size <= high), v, 0))
        high = low
    return out


def search(k: int):
    def run(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        v, q = rows.astype(np.int64), queries.astype(np.int64)
        most = int(np.abs(v).max(initial=0)) * int(np.abs(q).max(initial=0)) * v.shape[1]
        own = np.searchsorted(ids, query_ids)
        own[own == len(ids)] = 0
        itself = ids[own] == query_ids
        kind = np.float32 if most < 1 << 24 else np.float64
        if most >= 1 << 53:  # beyond exact floating point
            for i in range(len(q)):
                score = v @ q[i]
                at = np.delete(np.arange(len(ids)), own[i]) if itself[i] else np.arange(len(ids))
                at = at[np.lexsort((ids[at], -score[at]))][:k]
                yield i, at, score[at]
            return
        segments = _segments(v)
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        rest = (v.astype(np.float64) ** 2).sum(axis=1)
        certain = np.zeros((len(q), len(v)), kind)
        alive = np.ones(certain.shape, bool)
        alive[np.flatnonzero(itself), own[itself]] = False
        for n, segment in enumerate(segments):
            certain += q.astype(kind) @ segment.T.astype(kind)
            rest = np.maximum(rest - (segment.astype(np.float64) ** 2).sum(axis=1), 0)
            if n == len(segments) - 1:
                rest[:] = 0
            for i in range(len(q)):
                gap = length[i] * np.sqrt(rest) * (1 + 1e-9)
                at = np.flatnonzero(alive[i])
                if len(at) > k:
                    low = certain[i, at] - gap[at]
                    sure = np.partition(low, len(at) - k)[len(at) - k]
                    alive[i, at] = certain[i, at] + gap[at] >= sure
            if alive.mean() <= _FEW:
                break
        for i in range(len(q)):
            at = np.flatnonzero(alive[i])
            score = v[at] @ q[i]
            order = np.lexsort((ids[at], -score))[:k]
            yield i, at[order], score[order]

    return run


def exact_topk(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(64 x) for the rows where `is_query` (on `id`) holds.

    A row is no candidate of its own id. Equal scores go to the smaller id; fewer candidates give fewer rows. Null or empty vectors, null
    ids, and vectors with null or non-finite components take no part; only vectors of one length are compared. Of rows that share an id
    the one with the smallest vector stands for it. Scores must fit 64 bits. An empty table gives no rows; other columns are ignored.
    """
    rows = finite(df, id_col, vector_col).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))
    return search_blocks(rows, is_query, search(k), "long", k, block, chunk)
