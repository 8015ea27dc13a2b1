"""Live odds: snapshots in, prices against predictions, movement since the last snapshot, limits and alerts out.

Event time is the snapshot time. The raw log keeps every snapshot, repeated and late ones too; the
cycle leaves out repeats and snapshots later than the watermark. All sinks write one folder per micro-batch under its id, so a batch that is
run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.functions import odds as O
from touchline.operators.windows import Previous, with_asof
from touchline.sources.shared import new_path

WATERMARK = "10 minutes"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> None:
    """Run a stream through `handle`; all that is available now, or once per interval until stopped."""
    state = new_path(stream.sparkSession, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(handle)
    q = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    q.awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into the shared folder, one folder per batch, and read the result back."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(stream, keep, mode)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(path)


def latest_update(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of a stream in update mode."""
    others = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Repeated snapshots dropped within the watermark."""
    return stream.withWatermark(time, WATERMARK).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- movement since the previous snapshot


class _LastOdds(StatefulProcessor):
    """Keeps the newest odds per match and outcome; emits each snapshot with its movement.

    A snapshot older than the newest one seen is emitted as `late`, without a movement, and leaves the state as it is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "odds double, ts timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        snapshots = pd.concat(list(rows)).sort_values(["ts", "snapshot_id"])
        seen, at = self._last.get() if self._last.exists() else (None, None)
        out = []
        for s in snapshots.itertuples(index=False):
            if at is not None and s.ts < at:
                out.append((key[0], key[1], s.snapshot_id, s.ts, s.odds, None, True))
                continue
            move = (s.odds - seen) / seen if seen is not None and seen > 0 else 0.0
            out.append((key[0], key[1], s.snapshot_id, s.ts, s.odds, move, False))
            seen, at = s.odds, s.ts
        if at is not None:
            self._last.update((seen, at))
        yield pd.DataFrame(out, columns=["match_key", "outcome", "snapshot_id", "ts", "odds", "live_clv", "late"])

    def close(self) -> None:
        pass


MOVEMENT_SCHEMA = "match_key bigint, outcome string, snapshot_id bigint, ts timestamp, odds double, live_clv double, late boolean"


def movement(stream: DataFrame) -> DataFrame:
    """(current - previous) / previous odds per match and outcome, 0 on first sight; state survives restarts."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return stream.groupBy("match_key", "outcome").transformWithStateInPandas(
        statefulProcessor=_LastOdds(), outputStructType=MOVEMENT_SCHEMA, outputMode="Append", timeMode="None"
    )


def movement_batch(snapshots: DataFrame, unit: str = "day") -> DataFrame:
    """The same on a table of snapshots."""
    out = with_asof(snapshots, ["match_key", "outcome"], ["ts", "snapshot_id"], {"_prev": Previous(F.col("odds"))}, unit)
    return out.withColumn("live_clv", F.coalesce(O.clv_live(F.col("odds"), F.col("_prev")), F.lit(0.0))).drop("_prev")


# ---------------------------------------------------------------- the cycle


def priced(snapshots: DataFrame, predictions: DataFrame, kelly_fraction: float = 0.25) -> DataFrame:
    """Snapshots joined to predictions (match_key, outcome, prob, spread) with value, stake share and confidence."""
    out = snapshots.join(predictions, ["match_key", "outcome"])
    p, o = F.col("prob"), F.col("odds")
    return out.withColumns(
        {"ev": O.expected_value(p, o), "kelly_stake": O.kelly(p, o) * kelly_fraction, "confidence": F.col("spread") * 100}
    )


def value_only(rows: DataFrame, min_ev: float = 0.02) -> DataFrame:
    return rows.filter(F.col("ev") >= min_ev)


def run_cycle(stream: DataFrame, predictions: DataFrame, root: str, keys: list[str], min_ev: float = 0.02) -> None:
    """First the raw log of all snapshots; then, without repeats of `keys`, priced rows, value bets and cycle metrics.

    Each micro-batch is written under its id.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = priced(batch, predictions).persist()
        rows.write.mode("overwrite").parquet(f"{root}/predictions/batch={batch_id}")
        value_only(rows, min_ev).write.mode("overwrite").parquet(f"{root}/value/batch={batch_id}")
        cycle_metrics(rows, min_ev).write.mode("overwrite").parquet(f"{root}/metrics/batch={batch_id}")
        rows.unpersist()

    run_batches(stream, log)
    run_batches(deduplicated(stream, keys), handle)


def cycle_metrics(rows: DataFrame, min_ev: float = 0.02) -> DataFrame:
    return rows.agg(
        F.count("*").alias("predictions"), F.count_if(F.col("ev") >= min_ev).alias("value_bets"), F.coalesce(F.avg("ev"), F.lit(0.0)).alias("mean_ev")
    )


def recent_history(log: DataFrame, limit: int = 1000) -> DataFrame:
    """Newest rows of an append-only log."""
    return log.orderBy(F.col("ts").desc(), F.col("snapshot_id").desc()).limit(limit)


# ---------------------------------------------------------------- windows


def sliding_counts(events: DataFrame, key: str, length: str = "1 hour", slide: str = "5 minutes", time: str = "ts") -> DataFrame:
    """Events per key in sliding windows, as a stream or a table."""
    timed = events.withWatermark(time, WATERMARK) if events.isStreaming else events
    return timed.groupBy(F.window(time, length, slide).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("window_start"), "n"
    )


def tumbling_totals(events: DataFrame, key: str, length: str, value: Column, time: str = "ts") -> DataFrame:
    """Count and sum per key and window: daily counters, metric rollups."""
    timed = events.withWatermark(time, WATERMARK) if events.isStreaming else events
    return timed.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        key, F.col("w.start").alias("window_start"), "n", "total"
    )


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Runs of events of a key without a longer gap; a stream emits a session once the watermark passed it."""
    timed = events.withWatermark(time, WATERMARK) if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


# ---------------------------------------------------------------- alerts


class _Cooldown(StatefulProcessor):
    """Remembers when a rule fired last and drops breaches inside its cooldown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._fired = handle.getValueState("fired", "ts timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self._fired.get()[0] if self._fired.exists() else None
        out = []
        for b in pd.concat(list(rows)).sort_values(["ts", "value"]).itertuples(index=False):
            if last is None or (b.ts - last).total_seconds() >= b.cooldown:
                last = b.ts
                out.append((key[0], b.ts, b.value, b.severity))
        if out:
            self._fired.update((last,))
        yield pd.DataFrame(out, columns=["rule", "ts", "value", "severity"])

    def close(self) -> None:
        pass


def alert_stream(breaches: DataFrame) -> DataFrame:
    """Breaches (rule, ts, value, severity, cooldown) that fire."""
    breaches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return breaches.groupBy("rule").transformWithStateInPandas(
        statefulProcessor=_Cooldown(), outputStructType="rule string, ts timestamp, value double, severity string", outputMode="Append", timeMode="None"
    )
