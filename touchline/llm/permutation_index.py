"""Operator 5: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Pivot inverted files post (row, place). For a query the files of its own pivots
give the footrule distance of every posted row; the nearest share of rows by footrule is reranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.vectors import finite, search_blocks

BLOCK, CHUNK = 8192, 512
PIVOTS = 256  # a bounded sample of vectors, chosen by a hash of the id
PREFIX = 48  # nearest pivots that represent a vector
SHARE = 0.25  # of a block's rows that are reranked, besides ties
LEAST = 64  # rows of a block that are reranked, at least


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is below 1; cosines keep every bit and norms neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _places(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector in order; ties go to the first pivot."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :prefix]


def search(k: int, pivots: np.ndarray, prefix: int, share: float):
    def run(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        count, queries = len(ids), _scaled(queries)
        rows, group = np.unique(_scaled(rows), axis=0, return_inverse=True)
        members = np.argsort(group.ravel(), kind="stable")  # rows by vector and then id
        begins = np.searchsorted(group.ravel()[members], np.arange(len(rows) + 1))
        size, asked = np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1)
        known = pivots[:, : rows.shape[1]] if pivots.shape[1] == rows.shape[1] else np.eye(rows.shape[1])[:PIVOTS]
        m = min(prefix, len(known))
        order = _places(rows / size[:, None], known, m)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        posted, place = (by_pivot // m).astype(np.int32), (by_pivot % m).astype(np.int32)
        starts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(known) + 1))
        wanted = _places(queries / asked[:, None], known, m)
        take = min(len(rows), max(LEAST, int(share * count)) + 1)
        for i in range(len(queries)):
            # footrule of two prefixes is m (m + 1) less twice the sum of m - max(place, place) over pivots of both
            near = np.zeros(len(rows), np.int32)
            for p, pivot in enumerate(wanted[i].tolist()):
                a, b = starts[pivot], starts[pivot + 1]
                near[posted[a:b]] += m - np.maximum(place[a:b], p)
            at = np.flatnonzero(near >= np.partition(near, len(rows) - take)[len(rows) - take])
            score = np.einsum("ij,j->i", rows[at], queries[i]) / (size[at] * asked[i])  # row by row, so equal vectors tie in all blocks
            if len(at) > k + 1:
                best = score >= np.partition(score, len(at) - k - 1)[len(at) - k - 1]
                at, score = at[best], score[best]
            # the smallest ids of each vector, one more than asked for, as the query's own goes
            n = np.minimum(begins[at + 1] - begins[at], k + 1)
            found = members[np.arange(n.sum()) + np.repeat(begins[at] - np.cumsum(n) + n, n)]
            score = np.repeat(score, n)[ids[found] != query_ids[i]]
            found = found[ids[found] != query_ids[i]]
            best = np.lexsort((ids[found], -score))[:k]
            yield i, found[best], score[best]

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine for the rows where `is_query` (on `id`) holds.

    Every row is indexed. A row is no candidate of its own id; equal scores go to the smaller id; fewer candidates give fewer rows. Null,
    empty or zero vectors, null ids, and vectors with null or non-finite components take no part; only vectors of one length are
    compared (pivots have the length of most sampled rows; other lengths use their axes). Of rows that share an id the one with the
    smallest vector stands for it. An empty table gives no rows; other columns are ignored.
    """
    rows = finite(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0.0))
    sample = rows.orderBy(F.xxhash64(F.lit(9), F.col("id")), "id").limit(pivots).select("v").collect()
    dims = [len(r.v) for r in sample]
    dim = max(set(dims), key=dims.count) if dims else 1
    p = np.array([r.v for r in sample if len(r.v) == dim], np.float64).reshape(-1, dim)
    if len(p):
        p = _scaled(p)
        p = p / np.linalg.norm(p, axis=1, keepdims=True)
    return search_blocks(rows, is_query, search(k, p, prefix, share), "double", k, block, chunk)
