"""Streams over the event table: each runs to the end of what is available and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import profile
from touchline.plans import inputs
from touchline.plans.common import rounded
from touchline.plans.registry import query
from touchline.sources.shared import new_path
from touchline.streaming import live

_EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# A snapshot's match is the user, its outcome the kind of event, its price follows from the value.
_SNAP = "user_id AS match_key, event_type AS outcome, event_id AS snapshot_id, CAST(ts AS TIMESTAMP) AS ts, 1.1e0 + value / 37e0 AS odds"
_SNAP_SQL = "WITH s AS (SELECT user_id AS match_key, event_type AS outcome, event_id AS snapshot_id, ts, 1.1e0 + value / 37e0 AS odds FROM events)\n"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return live.read_stream(spark, sf, _EVENT_SCHEMA, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _snapshots(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[c.strip() for c in _SNAP.split(", ")])


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities per match and outcome: one per customer and kind of event."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]))
    c = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("match_key"), kinds.alias("outcome"))
    return c.withColumns({"prob": (F.col("match_key") % 50 + F.length("outcome")) / 100.0, "spread": (F.col("match_key") % 30) / 100.0})


_PRED_SQL = "p AS (SELECT c_custkey AS match_key, outcome, (c_custkey % 50 + length(outcome)) / 100e0 AS prob, (c_custkey % 30) / 100e0 AS spread FROM customer, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS outcome) k)"


_MOVE_SQL = _SNAP_SQL + """SELECT match_key, outcome, snapshot_id, round(odds, 6) AS odds, round(coalesce((odds - lag(odds) OVER w) / lag(odds) OVER w, 0), 6) AS live_clv FROM s
WINDOW w AS (PARTITION BY match_key, outcome ORDER BY ts, snapshot_id)"""


@query("live_movement_stream", "12.2", _MOVE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = live.run_to_table(live.movement(_snapshots(_stream(spark, sf))), "movement")
    return rounded(out, ["match_key", "outcome", "snapshot_id"], ["odds", "live_clv"])


@query("live_movement_batch", "12.2", _MOVE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = live.movement_batch(_snapshots(inputs.table(spark, sf, "events")))
    return rounded(out, ["match_key", "outcome", "snapshot_id"], ["odds", "live_clv"])


_CYCLE = (
    _SNAP_SQL.strip()
    + f""", {_PRED_SQL}, c AS (SELECT s.*, prob, spread, CASE WHEN odds > 1 THEN prob * odds - 1 ELSE 0 END AS ev, CASE WHEN prob * odds > 1 THEN least((prob * odds - 1) / (odds - 1), 1) * 0.25 ELSE 0 END AS k FROM s JOIN p USING (match_key, outcome))
"""
)


def _cycle(spark: SparkSession, sf: str) -> str:
    root = new_path(spark, "live")
    live.run_cycle(_snapshots(_stream(spark, sf)), _predictions(spark, sf), root, ["snapshot_id"])
    return root


@query(
    "live_cycle",
    "12.1 12.3",
    _CYCLE + "SELECT match_key, outcome, snapshot_id, round(ev, 6) AS ev, round(k, 6) AS kelly_stake, round(spread * 100, 6) AS confidence FROM c",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = spark.read.parquet(f"{_cycle(spark, sf)}/predictions")
    return rounded(out, ["match_key", "outcome", "snapshot_id"], ["ev", "kelly_stake", "confidence"])


@query("live_value_bets", "12.4 12.10", _CYCLE + "SELECT match_key, outcome, snapshot_id, round(ev, 6) AS ev FROM c WHERE ev >= 0.02")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spark.read.parquet(f"{_cycle(spark, sf)}/value"), ["match_key", "outcome", "snapshot_id"], ["ev"])


@query("live_cycle_metrics", "12.11", _CYCLE + "SELECT count(*) AS predictions, count(*) FILTER (ev >= 0.02) AS value_bets, round(avg(ev), 6) AS mean_ev FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.read.parquet(f"{_cycle(spark, sf)}/metrics")
    m = m.filter("predictions > 0").groupBy().agg(
        F.sum("predictions").alias("predictions"), F.sum("value_bets").alias("value_bets"), (F.sum(F.col("mean_ev") * F.col("predictions")) / F.sum("predictions")).alias("mean_ev")
    )
    return rounded(m, ["predictions", "value_bets"], ["mean_ev"])


@query("live_snapshot_log", "12.8 12.9", _SNAP_SQL + "SELECT match_key, outcome, snapshot_id FROM s ORDER BY ts DESC, snapshot_id DESC LIMIT 1000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = live.run_to_table(_snapshots(_stream(spark, sf)), "log")
    return live.recent_history(log).select("match_key", "outcome", "snapshot_id")


_SLIDE_SQL = """WITH w AS (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS window_start FROM events)
SELECT user_id, window_start, count(*) AS n FROM w GROUP BY ALL"""


@query("stream_sliding_counts", "12.5", _SLIDE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = live.sliding_counts(_stream(spark, sf), "user_id", "1 hour", "15 minutes")
    out = live.latest_update(live.run_to_table(s, "sliding", "update"), ["user_id", "window_start"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("batch_sliding_counts", "12.5", _SLIDE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.sliding_counts(e, "user_id", "1 hour", "15 minutes")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_daily_counters",
    "12.6 12.7",
    "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = live.tumbling_totals(_stream(spark, sf), "event_type", "1 day", F.col("value"))
    out = live.latest_update(live.run_to_table(s, "daily", "update"), ["event_type", "window_start"])
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query(
    "batch_sessions",
    "12.7",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM i GROUP BY user_id, i""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.sessions(e, "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_alerts", "12.12")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.plans.queries_quality import _rules

    metrics = _stream(spark, sf).select(F.col("event_type").alias("metric"), "ts", "value")
    hit = profile.breaches(metrics, F.broadcast(_rules(spark))).select("rule", "ts", "value", "severity", "cooldown")
    out = live.run_to_table(live.alert_stream(hit), "alerts")
    return out.select("rule", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "severity")
