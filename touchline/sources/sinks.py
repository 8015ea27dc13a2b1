"""Writes: files, insert-if-absent, upsert, feature cache and exports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("league", "season"), mode: str = "overwrite") -> None:
    """Partitioned files; rows are first brought together by partition, and partitions that are large are split by their size."""
    keys = [c for c in partition_by if c in df.columns]
    out = df.hint("rebalance", *keys) if keys else df
    writer = out.write.mode(mode).partitionBy(*keys) if keys else out.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def insert_if_absent(batch: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows and those of the batch whose key is not stored; the first of a repeated key."""
    from touchline.operators.joins import new_rows

    return stored.unionByName(new_rows(batch, stored, keys, order).select(*stored.columns))


def append_if_absent(batch: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Append to the parquet table at `path` the rows whose key it lacks."""
    from touchline.operators.joins import new_rows

    spark = batch.sparkSession
    new_rows(batch, spark.read.parquet(path), keys, order).write.mode("append").parquet(path)


def upsert(batch: DataFrame, stored: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Latest row per key over both; on equal times the batch wins."""
    both = stored.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    others = [c for c in stored.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(newest, "_b"))
    return both.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*stored.columns)


def cached_features(spark: SparkSession, root: str, recipe: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Feature table kept under the hash of its recipe; built and written on first use."""
    path = f"{root}/features-{hashlib.sha256(recipe.encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_predictions(df: DataFrame, path: str, fmt: str = "json") -> None:
    write_files(df, path, fmt, ())


def export_metrics(metrics: DataFrame, path: str) -> None:
    """One CSV folder per metric."""
    metrics.write.mode("overwrite").option("header", True).partitionBy("metric").csv(path)
