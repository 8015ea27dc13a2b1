"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.shared import new_path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once as parquet in the shared folder and read it back; survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """The same table, marked for broadcast if its count is at most `rows`; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the fifth of the ids with remainder 0 is held out. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; null ids count as held out."""
    return ~learnable(doc_id)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, chosen by a hash of the key; all rows where there are fewer. Used to fit classifiers and to choose orders only."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * rows / total))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty; no Python string is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no run of equal keys is cut; the input is sorted by the key within its partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        starts = pc.index(pc.equal(keys, last), True).as_py()
        if held and starts == 0 and held[-1].column(key)[-1].as_py() == last.as_py():
            held.append(batch)
            continue
        if starts or held:
            yield pa.Table.from_batches([*held, batch.slice(0, starts)])
        held = [batch.slice(starts)]
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (wraps on purpose)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """`text` and `label` (double) of about `rows` labelled documents that may be learned from; the largest label of a repeated id.

    Labels of no document, null labels and null ids are left out. The sample is bounded, so it is sent to the documents.
    """
    known = labels.where(learnable(F.col("doc_id")) & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(column).cast("double").alias("label"))
    picked = F.broadcast(bounded_sample(known, "__id", rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(picked, "__id")
