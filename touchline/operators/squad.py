"""Squad aggregates per team and their join to both sides of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import position_group

DEFAULT_RATING = 6.0


def _clip(c: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def squad_stats(players: DataFrame) -> DataFrame:
    """Ratings from log market value, depth, availability, value shares and age scales per team.

    A rating is 4 + 3 * log value / team maximum, so its mean needs only the mean and the maximum
    of the logs: one aggregation per team, plus the few most valuable players for the top shares.
    """
    value = F.when(F.col("market_value") == 0, 0.1).otherwise(F.col("market_value"))
    pos = position_group(F.col("position"))
    away = (F.coalesce("injured", F.lit(0)) == 1) | (F.coalesce("suspended", F.lit(0)) == 1)
    p = players.select(
        "team", "player_id", "market_value", "age", "goals", "injured",
        value.alias("value"), F.log1p(value).alias("logv"), pos.alias("pos"), away.alias("away"),
    )

    def at(*groups: str) -> Column:
        return F.col("pos").isin(*groups)

    aggs = [
        F.count("*").alias("total"),
        F.count_if("away").alias("n_unavailable"),
        F.max("logv").alias("max_log"),
        F.avg("logv").alias("log_all"),
        F.sum("value").alias("total_value"),
        F.coalesce(F.sum(F.when(F.col("away"), F.col("market_value"))), F.lit(0.0)).alias("away_value"),
        F.avg("age").alias("avg_age"),
        F.avg(F.when(at("DEF"), F.col("age"))).alias("def_age"),
        F.avg(F.when(at("FWD", "MID"), F.col("age"))).alias("pace_age"),
        F.coalesce(F.sum(F.when(at("FWD"), F.col("goals"))), F.lit(0)).alias("fwd_goals"),
        F.sum("injured").alias("injured"),
    ]
    for g in ("GK", "DEF", "MID", "FWD"):
        aggs += [
            F.count_if(at(g)).alias(f"n_{g}"),
            F.count_if(at(g) & ~F.col("away")).alias(f"ready_{g}"),
            F.avg(F.when(at(g), F.col("logv"))).alias(f"log_{g}"),
            F.coalesce(F.sum(F.when(at(g), F.col("market_value"))), F.lit(0.0)).alias(f"value_{g}"),
        ]
    t = p.groupBy("team").agg(*aggs)
    by_value = Window.partitionBy("team").orderBy(F.col("value").desc(), "player_id")
    top = (
        p.select("team", "player_id", "value", "market_value")
        .withColumn("rn", F.row_number().over(by_value))
        .filter("rn <= 11")
        .groupBy("team")
        .agg(F.sum(F.when(F.col("rn") <= 3, F.col("value"))).alias("top3"), F.sum("market_value").alias("top11"))
    )
    t = t.join(top, "team")

    def rating(c: str) -> Column:
        r = F.when(F.col("max_log") > 0, 4 + 3 * F.col(c) / F.col("max_log")).otherwise(6.0)
        return F.when(F.col(c).isNull(), DEFAULT_RATING).otherwise(_clip(r, 1.0, 10.0))

    def depth(g: str, full: int) -> Column:
        return F.least(F.col(f"ready_{g}"), F.lit(full)) / F.lit(float(full))

    whole = F.greatest(F.col("total_value"), F.lit(1.0))

    def part(c: Column) -> Column:
        return _clip(10 * F.least(c / whole * 2, F.lit(1.0)))

    ready = (F.col("total") - F.col("n_unavailable")) / F.col("total")
    top3 = F.when(F.col("total_value") > 0, F.col("top3") / F.col("total_value")).otherwise(1.0)
    def_rating = rating("log_DEF")
    out = {
        "rating_avg": (rating("log_all"), 2),
        "rating_gk": (rating("log_GK"), 2),
        "rating_def": (def_rating, 2),
        "rating_mid": (rating("log_MID"), 2),
        "rating_fwd": (rating("log_FWD"), 2),
        "squad_depth_score": (
            F.least(10 * (0.25 * depth("GK", 3) + 0.30 * depth("DEF", 8) + 0.25 * depth("MID", 8) + 0.20 * depth("FWD", 6)), F.lit(10.0)),
            2,
        ),
        "form_index": (_clip(10 * (ready * (1 - 0.3 * top3))), 2),
        "key_player_impact": (F.least(F.col("away_value") / whole, F.lit(1.0)), 3),
        "experience_score": (_clip(10 * (F.col("avg_age") - 18) / 20), 2),
        "attack_strength": (part(F.col("value_FWD")), 2),
        "defence_strength": (part(F.col("value_DEF") + F.col("value_GK")), 2),
        "midfield_control": (part(F.col("value_MID")), 2),
        "set_piece_threat": (
            _clip(
                10
                * (
                    0.5 * F.least(F.coalesce("def_age", F.lit(25.0)) / 30, F.lit(1.0))
                    + 0.5 * F.least(def_rating / 10, F.lit(1.0))
                )
            ),
            2,
        ),
        "pace_index": (_clip(10 * (1 - (F.coalesce("pace_age", F.lit(25.0)) - 18) / 20)), 2),
        "discipline_score": (_clip(10 * F.least(F.col("avg_age") / 30, F.lit(1.0))), 2),
        "goals_per_fwd": (F.col("fwd_goals") / F.greatest(F.col("n_FWD"), F.lit(1)), 2),
        "injury_rate": (F.col("injured") / F.greatest(F.col("total"), F.lit(1)), 3),
        "starter_quality": (part(F.col("top11")), 2),
        "avg_age": (F.col("avg_age"), 1),
        "total_value": (F.col("total_value"), 1),
    }
    return t.select(
        "team", F.col("total").alias("squad_size"), "n_unavailable", *[F.round(c, d).alias(n) for n, (c, d) in out.items()]
    )


def squad_info(players: DataFrame) -> DataFrame:
    """Injured and suspended counts, mean age, value, and whether keeper or top scorer is missing.

    The keeper is missing when a designated starter is out, or, without one, when no keeper is fit.
    """
    keeper = F.upper("position").contains("GK")
    out = (F.col("injured") == 1) | (F.col("suspended") == 1)
    starter = F.col("is_starter") == 1
    scorer = F.max(F.struct(F.col("goals").alias("g"), (-F.col("player_id")).alias("i"), out.alias("out")))
    starters = F.count_if(keeper & starter)
    gk_out = F.when(starters > 0, F.count_if(keeper & starter & out) > 0).otherwise(
        (F.count_if(keeper) > 0) & (F.count_if(keeper & ~out) == 0)
    )
    return players.groupBy("team").agg(
        F.sum("injured").alias("injured_count"),
        F.sum("suspended").alias("suspended_count"),
        F.round(F.avg("age"), 1).alias("avg_age"),
        F.round(F.sum("market_value"), 1).alias("squad_value"),
        gk_out.alias("missing_gk"),
        scorer.getField("out").alias("missing_top_scorer"),
    )


def join_both_sides(matches: DataFrame, per_team: DataFrame, columns: list[str], fill: dict[str, float] | None = None) -> DataFrame:
    """Left-join a per-team table to the home and away side with `h_` and `a_` columns."""
    out = matches
    for side, p in (("home", "h"), ("away", "a")):
        named = per_team.select(F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
        out = out.join(named, f"{side}_team", "left")
        for c, v in (fill or {}).items():
            out = out.withColumn(f"{p}_{c}", F.coalesce(F.col(f"{p}_{c}"), F.lit(v)))
    return out
