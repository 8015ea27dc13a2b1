"""Connected components of an edge table: blocks of edges are contracted to stars, then labels spread between the stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import written
from touchline.sources.shared import cut_lineage

BLOCK = 1_000_000  # edges that one task contracts, about


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task as (id, root) rows: root is the smallest id that these edges reach from id; roots themselves included."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, x, y = np.arange(len(ids)), codes[: len(a)], codes[len(a) :]
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        for at in (x, y, low[x], low[y]):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], names=["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of long ids -> (id, root) for every id on an edge; root is the smallest id that can be reached.

    One block of edges is settled by its contraction. With more, each round takes the smallest label among neighbours and then the
    label of that label, so long chains end in few rounds.
    """
    edges = written(edges.select("a", "b").where("a <> b"), "edges")
    blocks = -(-edges.count() // BLOCK)
    stars = written(edges.coalesce(max(1, blocks)).mapInArrow(_stars, "id long, root long"), "stars")
    if blocks <= 1:
        return stars
    tied = stars.select(F.col("id").alias("a"), F.col("root").alias("b"))
    both = cut_lineage(tied.union(tied.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = cut_lineage(step.join(up, "root", "left").select("id", "was", F.least("root", "up").alias("root")))
        labels = step.select("id", "root")
        if step.where("was <> root").isEmpty():
            return labels
