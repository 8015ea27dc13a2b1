"""Vectors and stated queries dealt to units of a block of rows and a chunk of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import partitions, run_bounds, whole_runs

Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def finite(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of one or more finite components, as doubles."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def _one_each(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by id; of rows that share an id the one with the smallest vector stands for it."""
    order = np.lexsort((*v.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    return ids[first], v[first]


def search_blocks(rows: DataFrame, is_query: Column, search: Search, score: str, k: int, block: int, chunk: int) -> DataFrame:
    """Every query against every row of equal length: units of one block and one chunk, each giving its best k, then the best of all.

    `search(ids, vectors, query_ids, queries)` yields (query's position, rows' positions, scores). Rows are dealt by a hash of the id,
    so blocks are even and repeated ids meet.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("dim", F.size("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, chunks = max(1, -(-sizes.n // block)), max(1, -(-sizes.q // chunk))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.withColumns({"b": deal(blocks, 1), "asks": F.lit(False)}).withColumn("c", span(chunks))
    asked = rows.where(is_query).withColumns({"c": deal(chunks, 2), "asks": F.lit(True)}).withColumn("b", span(blocks))
    units = held.unionByName(asked).withColumn("unit", F.xxhash64("dim", "b", "c")).select("unit", "id", "asks", "v")
    units = units.repartition(max(partitions(spark), 1), "unit").sortWithinPartitions("unit", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            bounds = run_bounds(table.column("unit").to_numpy())
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(s, e - s).combine_chunks()
                ids, asks = part.column("id").to_numpy(), part.column("asks").to_numpy()
                v = part.column("v").combine_chunks()
                v = v.flatten().to_numpy().reshape(len(ids), -1)
                row_ids, row_v = _one_each(ids[~asks], v[~asks])
                query_ids, query_v = _one_each(ids[asks], v[asks])
                if not len(row_ids) or not len(query_ids):
                    continue
                q, found, scores = [], [], []
                for i, at, value in search(row_ids, row_v, query_ids, query_v):
                    q.append(np.full(len(at), query_ids[i]))
                    found.append(row_ids[at])
                    scores.append(value)
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores)).cast(kind)], names=["query_id", "vec_id", "score"])

    kind = pa.int64() if score == "long" else pa.float64()
    best = units.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
