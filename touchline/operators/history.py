"""Head-to-head, schedule, league-table and league-wide history features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geo import haversine_km
from touchline.operators.form import ORDER, team_game_log
from touchline.operators.windows import Expanding, Feature, Previous, Trailing, block_of, with_asof
from touchline.sources.shared import written

H2H_METRICS: dict[str, str] = {
    "wins": "CAST(points = 3 AS INT)",
    "draws": "CAST(points = 1 AS INT)",
    "losses": "CAST(points = 0 AS INT)",
    "goals_scored": "scored",
    "goals_conceded": "conceded",
    "goal_diff": "scored - conceded",
    "btts": "CAST(scored > 0 AND conceded > 0 AS INT)",
    "over_2_5": "CAST(scored + conceded > 2.5 AS INT)",
    "clean_sheets": "CAST(conceded = 0 AS INT)",
    "xg": "xg",
    "xga": "xga",
    "xgd": "xg - xga",
}


def ordered_pair_h2h(matches: DataFrame, window: int = 6, unit: str = "year") -> DataFrame:
    """History of the same home team hosting the same away team; `window <= 0` means all of it."""
    values = {
        "home_points_avg": F.expr("CASE result WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END"),
        "away_points_avg": F.expr("CASE result WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END"),
        "total_goals_avg": F.col("home_goals") + F.col("away_goals"),
        "home_win_rate": (F.col("result") == "H").cast("int"),
        "home_goals_avg": F.col("home_goals"),
        "away_goals_avg": F.col("away_goals"),
    }
    feats: dict[str, Feature] = {
        n: Trailing(v, window) if window > 0 else Expanding(v, "avg") for n, v in values.items()
    }
    feats["matches_played"] = Expanding(F.col("result"), "count")
    return with_asof(matches, ["home_team", "away_team"], ORDER, feats, unit)


def directed_pair_h2h(
    matches: DataFrame,
    windows: tuple[int, ...] = (3, 5, 10),
    context: str = "overall",
    metrics: dict[str, str] | None = None,
    unit: str = "year",
) -> DataFrame:
    """Record of a team against one opponent; pairs that met only once stay null by themselves."""
    keys = ["team", "opponent", *(["is_home"] if context == "venue" else [])]
    feats: dict[str, Feature] = {
        f"h2h_{context}_{m}_last{w}": Trailing(F.expr(e), w) for m, e in (metrics or H2H_METRICS).items() for w in windows
    }
    return with_asof(team_game_log(matches), keys, ORDER, feats, unit)


def unordered_pair_h2h(matches: DataFrame, values: dict[str, Column], window: int = 5, unit: str = "year") -> DataFrame:
    """Last meetings of two teams at either venue; first meetings get the mean of the whole frame."""
    paired = matches.withColumn("pair", F.array_sort(F.array("home_team", "away_team")))
    feats: dict[str, Feature] = {f"h2h_{n}_last_{window}": Trailing(v, window) for n, v in values.items()}
    out = with_asof(paired, ["pair"], ORDER, feats, unit)
    means = {n: matches.agg(F.avg(v)).scalar() for n, v in values.items()}
    for n in values:
        c = f"h2h_{n}_last_{window}"
        out = out.withColumn(c, F.coalesce(F.col(c), means[n]))
    return out.drop("pair")


def expanding_rates(
    matches: DataFrame, keys: list[str], values: dict[str, tuple[Column, float]], unit: str = "month"
) -> DataFrame:
    """Mean of all earlier matches of the key (league, league and season), with a fill for the first."""
    out = with_asof(matches, keys, ORDER, {n: Expanding(v) for n, (v, _) in values.items()}, unit)
    return out.fillna({n: fill for n, (_, fill) in values.items()})


def target_encode_expanding(
    df: DataFrame, key: str, target: Column, prior: float, name: str, order: list[str] | None = None, unit: str = "month"
) -> DataFrame:
    """Mean target of earlier rows of the same category; the prior when there are none."""
    out = with_asof(df, [key], order or ORDER, {name: Expanding(target)}, unit)
    return out.fillna({name: prior})


# ---------------------------------------------------------------- schedule


def schedule(matches: DataFrame, per_league: bool = True, unit: str = "year") -> DataFrame:
    """Rest days, gap to the last game in the competition and back-to-back opponents."""
    keys = ["team", *(["league"] if per_league else [])]
    out = with_asof(
        team_game_log(matches),
        keys,
        ORDER,
        {"_date": Previous(F.col("match_date")), "_opp": Previous(F.col("opponent"))},
        unit,
    )
    out = out.select(
        *[c for c in out.columns if not c.startswith("_")],
        F.datediff("match_date", "_date").alias("rest_days"),
        F.coalesce((F.col("opponent") == F.col("_opp")).cast("int"), F.lit(0)).alias("is_back_to_back"),
    )
    comp = with_asof(out, ["team", "league"], ORDER, {"_comp": Previous(F.col("match_date"))}, unit)
    return comp.withColumn("days_since_competition", F.datediff("match_date", "_comp")).drop("_comp")


def recent_match_counts(matches: DataFrame, days: tuple[int, ...] = (7, 14), per_league: bool = False) -> DataFrame:
    """Earlier games of the team in the last `d` days, games earlier on the same day included.

    Games are first counted per team and day, so the range frame runs over calendar days, not games.
    """
    keys = ["team", *(["league"] if per_league else [])]
    log = team_game_log(matches)
    daily = log.groupBy(*keys, "match_date").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.unix_date("match_date"))
    for d in days:
        daily = daily.withColumn(f"_d{d}", F.coalesce(F.sum("_n").over(w.rangeBetween(-d, -1)), F.lit(0)))
    same_day = Window.partitionBy(*keys, "match_date").orderBy("match_id")
    out = log.withColumn("_today", F.row_number().over(same_day) - 1).join(daily, [*keys, "match_date"])
    return out.select(
        *log.columns, *[(F.col(f"_d{d}") + F.col("_today")).alias(f"matches_last_{d}_days") for d in days]
    )


def venue_streaks(matches: DataFrame, per_league: bool = True, unit: str = "year") -> DataFrame:
    """Place of the game in the current run of home or away games; null for the first of a run."""
    keys = ["team", *(["league"] if per_league else [])]
    log = team_game_log(matches).withColumn("_block", block_of("match_date", unit))
    w = Window.partitionBy(*keys, "_block").orderBy(*ORDER)
    home = F.col("is_home") == 1
    rows = log.withColumn("_rn", F.row_number().over(w))
    per_block = rows.groupBy(*keys, "_block").agg(
        F.count("*").alias("_len"), F.max(F.when(home, F.col("_rn"))).alias("_lh"), F.max(F.when(~home, F.col("_rn"))).alias("_la")
    )
    before = Window.partitionBy(*keys).orderBy("_block")
    per_block = per_block.withColumn(
        "_base", F.coalesce(F.sum("_len").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    carried = before.rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(
        *keys,
        "_block",
        "_base",
        F.coalesce(F.max(F.col("_base") + F.col("_lh")).over(carried), F.lit(0)).alias("_ph"),
        F.coalesce(F.max(F.col("_base") + F.col("_la")).over(carried), F.lit(0)).alias("_pa"),
    )
    at = F.col("_base") + F.col("_rn")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(per_block, [*keys, "_block"])
    last_home = F.greatest(F.col("_ph"), F.max(F.when(home, at)).over(past))
    last_away = F.greatest(F.col("_pa"), F.max(F.when(~home, at)).over(past))
    run = F.when(home, at - last_away - 1).otherwise(at - last_home - 1)
    out = out.withColumn("_run", run)
    place = F.when(F.col("_run") > 0, F.col("_run"))
    return out.select(
        *team_game_columns(log), F.when(home, place).alias("consec_home"), F.when(~home, place).alias("consec_away")
    )


def team_game_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if not c.startswith("_")]


def travel_distance(matches: DataFrame, venues: DataFrame, max_km: float = 20_000.0, unit: str = "year") -> DataFrame:
    """Distance from the venue of the team's previous game; `venues` is (team, lat, lon)."""
    log = team_game_log(matches)
    at_home_of = F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opponent"))
    place = venues.select(F.col("team").alias("_host"), "lat", "lon")
    located = log.withColumn("_host", at_home_of).join(place, "_host", "left").drop("_host")
    out = with_asof(located, ["team"], ORDER, {"_lat": Previous(F.col("lat")), "_lon": Previous(F.col("lon"))}, unit)
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    return out.withColumn("_km", km).select(
        *log.columns, F.when(F.col("_km") < max_km, F.col("_km")).alias("travel_distance")
    )


# ---------------------------------------------------------------- league table


def league_positions(matches: DataFrame) -> DataFrame:
    """Place, points and games of both teams in the season's table just before each match.

    Teams are ranked by points, goal difference and name among the teams that have played and the two that play. A team's totals hold from
    one of its games (not included) to its next one (included). These spells are laid on the days when the league plays, so a match
    meets the spells of its own day only and counts those ahead of either side; a task holds days of a league, not a whole table's history.
    """
    of = ["season", "league"]
    w = Window.partitionBy(*of, "team").orderBy("match_date", "match_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    gained = F.coalesce("scored", F.lit(0)) - F.coalesce("conceded", F.lit(0))
    log = team_game_log(matches).select(
        *of, "match_date", "match_id", "team", "is_home", F.coalesce("points", F.lit(0)).alias("_got"), gained.alias("_up"),
        F.coalesce(F.sum("points").over(past), F.lit(0)).alias("pts"), F.coalesce(F.sum(gained).over(past), F.lit(0)).alias("gd"), (F.row_number().over(w) - 1).cast("long").alias("n"),
        F.lead("match_date").over(w).alias("_end"), F.lead("match_id").over(w).alias("_end_id"),
    )
    days = log.select(*of, "match_date").distinct()
    by_day = Window.partitionBy(*of)
    days = days.select(*of, "match_date", F.row_number().over(by_day.orderBy("match_date")).alias("day"), F.count("*").over(by_day).cast("int").alias("days"))
    log = written(log.join(days, [*of, "match_date"]), "table")
    first = log.select(*of, F.col("match_date").alias("_end"), F.col("day").alias("_last")).distinct()
    spells = log.join(first, [*of, "_end"], "left").select(
        *of, F.explode(F.sequence("day", F.coalesce("_last", "days"))).alias("day"), F.col("day").alias("_from"), "_last", F.col("match_id").alias("_from_id"), "_end_id",
        F.col("team").alias("_team"), (F.col("pts") + F.col("_got")).alias("_pts"), (F.col("gd") + F.col("_up")).alias("_gd"),
    )
    home, away = (
        log.filter(f"is_home = {flag}").select(*(of if flag else []), *(["day"] if flag else []), "match_id", *[F.col(c).alias(f"{side}_{c}") for c in ("team", "pts", "gd", "n")])
        for side, flag in (("h", 1), ("a", 0))
    )
    games = home.join(away, "match_id")

    def ahead(x: str, y: str) -> Column:
        """Whether x is placed before y; both are prefixes of columns."""
        p, g, t = ((F.col(f"{x}_{c}"), F.col(f"{y}_{c}")) for c in ("pts", "gd", "team"))
        return (p[0] > p[1]) | ((p[0] == p[1]) & ((g[0] > g[1]) | ((g[0] == g[1]) & (t[0] < t[1]))))

    began = (F.col("_from") < F.col("day")) | (F.col("_from_id") < F.col("match_id"))
    holds = F.col("_last").isNull() | (F.col("_last") > F.col("day")) | (F.col("_end_id") >= F.col("match_id"))
    others = (F.col("_team") != F.col("h_team")) & (F.col("_team") != F.col("a_team"))
    met = games.join(spells, [*of, "day"]).filter(began & holds & others & (ahead("", "h") | ahead("", "a")))
    counts = met.groupBy("match_id").agg(F.count_if(ahead("", "h")).alias("_h"), F.count_if(ahead("", "a")).alias("_a"))
    out = games.join(counts, "match_id", "left")

    def place(c: str, better: Column) -> Column:
        return F.lit(1) + F.coalesce(c, F.lit(0)) + better.cast("long")

    return out.select(
        "match_id", place("_h", ahead("a", "h")).alias("league_position"), F.col("h_pts").cast("long").alias("points_total"), F.col("h_n").alias("matches_played_league"),
        place("_a", ahead("h", "a")).alias("away_league_position"), F.col("a_pts").cast("long").alias("away_points_total"), F.col("a_n").alias("away_matches_played_league"),
    )

