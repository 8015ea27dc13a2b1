"""Risk limits: rolling counts and running totals as windows, and the accept-or-reject fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.windows import Expanding, with_asof


def daily_loss(bets: DataFrame, account: str = "account", limit_pct: float = 15.0, unit: str = "day") -> DataFrame:
    """Loss so far on the day as a share of the bankroll at its start, before each bet."""
    first = bets.groupBy(account, F.to_date("ts").alias("day")).agg(F.min_by("bankroll_before", F.struct("ts", "bet_id")).alias("day_start"))
    keyed = bets.withColumn("day", F.to_date("ts"))
    out = with_asof(keyed, [account, "day"], ["ts", "bet_id"], {"_lost": Expanding(F.greatest(-F.col("profit"), F.lit(0.0)), "sum")}, unit)
    out = out.join(first, [account, "day"])
    pct = F.coalesce(F.col("_lost"), F.lit(0.0)) / F.col("day_start") * 100
    return out.withColumn("daily_loss_pct", pct).withColumn("blocked", F.col("daily_loss_pct") >= limit_pct).drop("_lost")


def drawdown_limit(bets: DataFrame, account: str = "account", limit_pct: float = 25.0, unit: str = "day") -> DataFrame:
    """Drawdown from the highest bankroll so far, before each bet."""
    out = with_asof(bets, [account], ["ts", "bet_id"], {"_peak": Expanding(F.col("bankroll_before"), "max")}, unit)
    peak = F.greatest(F.col("_peak"), F.col("bankroll_before"))
    out = out.withColumn("drawdown_pct", F.when(peak > 0, (peak - F.col("bankroll_before")) / peak * 100).otherwise(0.0))
    return out.withColumn("blocked", F.col("drawdown_pct") >= limit_pct).drop("_peak")


def loss_streak(bets: DataFrame, account: str = "account", limit: int = 6, unit: str = "day") -> DataFrame:
    """Losses in a row just before each bet: bets so far less the place of the last win."""
    order = ["ts", "bet_id"]
    numbered = with_asof(bets, [account], order, {"_i": Expanding(F.lit(1), "count")}, unit)
    out = with_asof(numbered, [account], order, {"_last_win": Expanding(F.when(F.col("won") == 1, F.col("_i") + 1), "max")}, unit)
    out = out.withColumn("losses_in_row", F.col("_i") - F.coalesce("_last_win", F.lit(0)))
    return out.withColumn("blocked", F.col("losses_in_row") >= limit).drop("_i", "_last_win")


def frequency(bets: DataFrame, account: str = "account", per_hour: int = 3, per_day: int = 10, per_week: int = 40) -> DataFrame:
    """Bets of the account in the hour before, and earlier on the day and in the week.

    Counts come from totals per minute, day and week, so no window holds single bets of an account
    beyond one minute.
    """
    second = F.col("ts").cast("timestamp").cast("long")
    keyed = bets.withColumns({"_s": second, "_m": F.floor(second / 60), "_d": F.to_date("ts"), "_w": F.to_date(F.date_trunc("week", "ts"))})
    minute = keyed.groupBy(account, "_d", "_w", "_m").agg(F.count("*").alias("_n"))
    rank = Window.partitionBy(account).orderBy("_m")
    upto = Window.unboundedPreceding
    minute = minute.withColumns(
        {
            "_h": F.coalesce(F.sum("_n").over(rank.rangeBetween(-59, -1)), F.lit(0)),
            "_day": F.coalesce(F.sum("_n").over(Window.partitionBy(account, "_d").orderBy("_m").rowsBetween(upto, -1)), F.lit(0)),
            "_week": F.coalesce(F.sum("_n").over(Window.partitionBy(account, "_w").orderBy("_m").rowsBetween(upto, -1)), F.lit(0)),
        }
    ).select(account, "_m", "_h", "_day", "_week")
    # Bets of the minute an hour ago count when they fall inside the last 3600 seconds.
    inside = Window.partitionBy(account, "_m").orderBy("ts", "bet_id")
    seconds = keyed.groupBy(account, "_m", "_s").agg(F.count("*").alias("_c"))
    later = Window.partitionBy(account, "_m").orderBy(F.col("_s").desc()).rowsBetween(upto, 0)
    edge = seconds.withColumn("_after", F.sum("_c").over(later)).groupBy(account, "_m").agg(
        F.sort_array(F.collect_list(F.struct("_s", "_after"))).alias("_edge")
    )
    out = keyed.withColumn("_now", F.row_number().over(inside) - 1).join(minute, [account, "_m"])
    out = out.join(edge.withColumn("_m", F.col("_m") + 60), [account, "_m"], "left")
    partial = F.coalesce(F.get(F.filter("_edge", lambda e: e["_s"] > F.col("_s") - 3600), F.lit(0))["_after"], F.lit(0))
    out = out.withColumns(
        {
            "bets_last_hour": F.col("_h") + partial + F.col("_now"),
            "bets_today": F.col("_day") + F.col("_now"),
            "bets_this_week": F.col("_week") + F.col("_now"),
        }
    )
    blocked = (F.col("bets_last_hour") >= per_hour) | (F.col("bets_today") >= per_day) | (F.col("bets_this_week") >= per_week)
    return out.withColumn("blocked", blocked).select(*bets.columns, "bets_last_hour", "bets_today", "bets_this_week", "blocked")


def open_exposure(bets: DataFrame, account: str = "account", unit: str = "day") -> DataFrame:
    """Open bets and open stake when each bet is placed: placements add, settlements take away."""
    start = bets.select(account, F.col("ts").alias("at"), F.lit(1).alias("step"), F.col("stake").alias("amount"), "bet_id")
    end = bets.select(account, F.col("settled_ts").alias("at"), F.lit(-1).alias("step"), (-F.col("stake")).alias("amount"), "bet_id")
    out = with_asof(
        start.unionByName(end), [account], ["at", "step", "bet_id"],
        {"open_bets": Expanding(F.col("step"), "sum"), "open_stake": Expanding(F.col("amount"), "sum")}, unit,
    )
    return out.filter("step = 1").select(
        "bet_id", F.coalesce("open_bets", F.lit(0.0)).cast("long").alias("open_bets"), F.coalesce("open_stake", F.lit(0.0)).alias("open_stake")
    )


def group_exposure(bets: DataFrame, group: str, account: str = "account", limit_pct: float = 40.0, unit: str = "day") -> DataFrame:
    """Stake placed on a league or team so far, this bet included, as a share of the bankroll."""
    out = with_asof(bets, [account, group], ["ts", "bet_id"], {"_s": Expanding(F.col("stake"), "sum")}, unit)
    pct = (F.coalesce("_s", F.lit(0.0)) + F.col("stake")) / F.col("bankroll_before") * 100
    return out.withColumn("exposure_pct", pct).withColumn("blocked", F.col("exposure_pct") > limit_pct).drop("_s")


def stake_limits(max_single_pct: float = 25.0, min_odds: float = 1.5, max_odds: float = 20.0, excluded: tuple[str, ...] = (), preferred: tuple[str, ...] = ()):  # noqa: ANN201
    """Reason a bet breaks a limit that needs no history; null when it passes."""
    reason = (
        F.when(F.col("stake") / F.col("bankroll_before") * 100 > max_single_pct, "stake")
        .when(F.col("price") < min_odds, "odds_low")
        .when(F.col("price") > max_odds, "odds_high")
    )
    if excluded:
        reason = reason.when(F.col("league").isin(*excluded), "league_excluded")
    if preferred:
        reason = reason.when(~F.col("league").isin(*preferred), "league_not_preferred")
    return reason


@dataclass(frozen=True)
class RiskLimits:
    """Limits of the fold; the day starts anew at midnight."""

    bankroll: float = 1000.0
    daily_loss_pct: float = 15.0
    drawdown_pct: float = 25.0
    losses_in_row: int = 6
    per_day: int = 10
    single_pct: float = 25.0
    cooldown_minutes: int = 30


def gated_bets(bets: DataFrame, limits: RiskLimits, account: str = "account") -> DataFrame:
    """Accept or reject bets in order, where a rejected bet changes what later bets see.

    Every decision depends on the one before, so an account is read in order by one task; rows
    arrive in Arrow batches sorted by the JVM (spilling if needed) and only a few counters are kept.
    """
    cols = [account, "ts", "bet_id", "stake_share", "unit_return"]
    schema = f"{account} {dict(bets.dtypes)[account]}, bet_id bigint, accepted boolean, reason string, bankroll double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, s = None, {}
        for batch in batches:
            out = []
            for acc, ts, bet, share, ret in batch[cols].itertuples(index=False):
                if acc != owner:
                    owner = acc
                    s = {"bank": limits.bankroll, "peak": limits.bankroll, "day": None, "row": 0, "until": None}
                if s["day"] != ts.date():
                    s.update(day=ts.date(), start=s["bank"], lost=0.0, placed=0, row=0)
                reason = _first_breach(s, ts, share, limits)
                if reason in ("drawdown", "losses_in_row"):
                    s["until"] = ts + pd.Timedelta(minutes=limits.cooldown_minutes)
                if reason is None:
                    profit = s["bank"] * share * ret
                    s["bank"] += profit
                    s["peak"] = max(s["peak"], s["bank"])
                    s["placed"] += 1
                    s["lost"] += max(-profit, 0.0)
                    s["row"] = s["row"] + 1 if ret < 0 else 0
                out.append((acc, bet, reason is None, reason, s["bank"]))
            yield pd.DataFrame(out, columns=[account, "bet_id", "accepted", "reason", "bankroll"])

    ordered = bets.select(*cols).repartition(account).sortWithinPartitions(account, "ts", "bet_id")
    return ordered.mapInPandas(run, schema)


def _first_breach(s: dict, ts: pd.Timestamp, share: float, limits: RiskLimits) -> str | None:
    if s["until"] is not None and ts < s["until"]:
        return "cooldown"
    if s["start"] > 0 and s["lost"] / s["start"] * 100 >= limits.daily_loss_pct:
        return "daily_loss"
    if s["peak"] > 0 and (s["peak"] - s["bank"]) / s["peak"] * 100 >= limits.drawdown_pct:
        return "drawdown"
    if s["row"] >= limits.losses_in_row:
        return "losses_in_row"
    if s["placed"] >= limits.per_day:
        return "per_day"
    if share * 100 > limits.single_pct:
        return "stake"
    return None
