"""Team-game log and rolling form, read only from matches earlier in (date, id) order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.windows import Expanding, Feature, Previous, Trailing, with_asof, with_ewm

ORDER = ["match_date", "match_id"]

# home column, away column -> (own value, value given up) in the team-game log
PAIRED = {
    "goals": ("scored", "conceded"),
    "xg": ("xg", "xga"),
    "shots": ("shots", "shots_against"),
    "sot": ("sot", "sot_against"),
    "corners": ("corners", "corners_against"),
    "possession": ("possession", "possession_against"),
    "cards": ("cards", "cards_against"),
    "elo": ("elo", "opponent_elo"),
}

FORM_METRICS: dict[str, str] = {
    "points": "points",
    "goals_scored": "scored",
    "goals_conceded": "conceded",
    "total_goals": "scored + conceded",
    "over_2_5": "CAST(scored + conceded > 2.5 AS INT)",
    "btts": "CAST(scored > 0 AND conceded > 0 AS INT)",
    "clean_sheet": "CAST(conceded = 0 AS INT)",
    "scored_any": "CAST(scored > 0 AS INT)",
}

EXTENDED_METRICS: dict[str, str] = {
    "points": "points",
    "wins": "CAST(points = 3 AS INT)",
    "draws": "CAST(points = 1 AS INT)",
    "losses": "CAST(points = 0 AS INT)",
    "goals_scored": "scored",
    "goals_conceded": "conceded",
    "goal_diff": "scored - conceded",
    "clean_sheets": "CAST(conceded = 0 AS INT)",
    "btts": "CAST(scored > 0 AND conceded > 0 AS INT)",
    "over_2_5": "CAST(scored + conceded > 2.5 AS INT)",
    "under_2_5": "CAST(scored + conceded < 2.5 AS INT)",
    "xg": "xg",
    "xga": "xga",
    "xgd": "xg - xga",
    "shots": "shots",
    "sot": "sot",
}


def team_game_log(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each side, with points and every home/away pair present."""
    have = set(matches.columns)
    pairs = {k: v for k, v in PAIRED.items() if f"home_{k}" in have and f"away_{k}" in have}
    keep = [c for c in ("match_id", "match_date", "season", "league") if c in have]

    def side(own: str, other: str, win: str) -> Column:
        fields = [F.col(c) for c in keep]
        fields += [
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(int(own == "home")).alias("is_home"),
        ]
        for k, (mine, theirs) in pairs.items():
            fields += [F.col(f"{own}_{k}").alias(mine), F.col(f"{other}_{k}").alias(theirs)]
        fields.append(match_points(F.col("result"), win).alias("points"))
        return F.struct(*fields)

    return matches.select(F.explode(F.array(side("home", "away", "H"), side("away", "home", "A"))).alias("g")).select("g.*")


# Names of expected-goal columns, best first (fixed values).
XG_HOME = ("home_xg", "xg_home", "xghome", "h_xg", "hxg")
XG_AWAY = ("away_xg", "xg_away", "xgaway", "a_xg", "axg")


def with_expected_goals(matches: DataFrame, placeholder: float | None = 0.0) -> tuple[DataFrame, bool]:
    """`home_xg` and `away_xg` from the first column of a known name, whatever its case; else the placeholder.

    The flag tells whether both were found; one alone does not count.
    """
    at = {c.lower(): c for c in matches.columns}
    found = [next((at[n] for n in names if n in at), None) for names in (XG_HOME, XG_AWAY)]
    if None not in found:
        return matches.withColumnsRenamed({found[0]: "home_xg", found[1]: "away_xg"}), True
    return matches.withColumns({c: F.lit(placeholder).cast("double") for c in ("home_xg", "away_xg")}), False


def match_points(result: Column, win: str) -> Column:
    """3 for the side that wins, 1 for a draw, else 0."""
    return F.when(result == win, 3).when(result == "D", 1).otherwise(0)


def rolling(
    log: DataFrame,
    metrics: dict[str, str],
    windows: tuple[int, ...],
    keys: list[str],
    min_count: int = 1,
    name: str = "{metric}_avg{w}",
    unit: str = "year",
) -> DataFrame:
    """Mean of each metric over the `w` earlier rows of the key, for every window."""
    feats: dict[str, Feature] = {
        name.format(metric=m, w=w): Trailing(F.expr(e), w, "avg", min_count) for m, e in metrics.items() for w in windows
    }
    return with_asof(log, keys, ORDER, feats, unit)


def rolling_form(matches: DataFrame, windows: tuple[int, ...] = (5, 10), unit: str = "year") -> DataFrame:
    """Rolling means of the eight form metrics and goal difference, per team-game."""
    metrics = {**FORM_METRICS, "goal_diff": "scored - conceded"}
    return rolling(team_game_log(matches), metrics, windows, ["team"], unit=unit)


def rolling_form_ewm(
    matches: DataFrame, halflife: float = 5.0, goal_diff_halflives: tuple[int, ...] = (5, 10), unit: str = "year"
) -> DataFrame:
    """Exponentially weighted form; one halflife for the eight metrics, one per window for goal difference."""
    values = {f"{m}_ewm": (F.expr(e), halflife) for m, e in FORM_METRICS.items()}
    values |= {f"goal_diff_ewm{h}": (F.col("scored") - F.col("conceded"), float(h)) for h in goal_diff_halflives}
    return with_ewm(team_game_log(matches), ["team"], ORDER, values, unit)


def win_rates(matches: DataFrame, unit: str = "year") -> DataFrame:
    """Expanding win rates by venue, matches so far and days since the last match."""
    log = team_game_log(matches)
    won = (F.col("points") == 3).cast("int")
    home = F.col("is_home") == 1
    out = with_asof(
        log,
        ["team"],
        ORDER,
        {
            "_hw": Expanding(won * home.cast("int"), "sum"),
            "_aw": Expanding(won * (~home).cast("int"), "sum"),
            "_hm": Expanding(home.cast("int"), "sum"),
            "_am": Expanding((~home).cast("int"), "sum"),
            "win_rate_overall": Expanding(won, "avg"),
            "_prev": Previous(F.col("match_date")),
        },
        unit,
    )
    zero = F.lit(0.0)
    out = out.select(
        *log.columns,
        F.coalesce(F.try_divide("_hw", "_hm"), zero).alias("win_rate_home"),
        F.coalesce(F.try_divide("_aw", "_am"), zero).alias("win_rate_away"),
        "win_rate_overall",
        F.datediff("match_date", "_prev").alias("days_since_last_match"),
        F.col("_hm").cast("long").alias("home_matches"),
        F.col("_am").cast("long").alias("away_matches"),
    )
    seasonal = with_asof(out, ["team", "season"], ORDER, {"_n": Expanding(F.lit(1), "count")}, "quarter")
    return seasonal.withColumn("matches_this_season", F.when(F.col("_n") > 0, F.col("_n"))).drop("_n")


def to_match_rows(team_rows: DataFrame, features: list[str]) -> DataFrame:
    """Fold the two team rows of a match back into one row with `h_` and `a_` columns."""

    def of(side: int, c: str, prefix: str) -> Column:
        return F.max(F.when(F.col("is_home") == side, F.col(c))).alias(f"{prefix}_{c}")

    return team_rows.groupBy("match_id").agg(
        *[of(1, c, "h") for c in features], *[of(0, c, "a") for c in features]
    )


def running_average(matches: DataFrame, unit: str = "year") -> DataFrame:
    """Match mean of both teams' expanding scoring means; 1.0 when neither team has a past."""
    log = with_asof(
        team_game_log(matches),
        ["team"],
        ORDER,
        {"s": Expanding(F.col("scored")), "c": Expanding(F.col("conceded"))},
        unit,
    )
    one = F.lit(1.0)
    return log.groupBy("match_id").agg(
        F.coalesce(F.avg("s"), one).alias("league_avg_goals_scored"),
        F.coalesce(F.avg("c"), one).alias("league_avg_goals_conceded"),
    )


def attack_defence_ratios(
    matches: DataFrame, windows: tuple[int, ...] = (5,), denominator: str = "global", unit: str = "year"
) -> DataFrame:
    """Rolling scoring and conceding relative to the average.

    `denominator="global"` divides by the mean over the whole frame (it looks ahead);
    `"asof"` divides by the average known before the match.
    """
    names = [f"{m}_avg{w}" for m in ("goals_scored", "goals_conceded") for w in windows]
    metrics = {"goals_scored": "scored", "goals_conceded": "conceded"}
    sides = to_match_rows(rolling(team_game_log(matches), metrics, windows, ["team"], unit=unit), names)
    avg = running_average(matches, unit)
    both = (F.col("league_avg_goals_scored") + F.col("league_avg_goals_conceded")) / 2
    if denominator == "global":
        mean = avg.agg(F.avg(both).alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)).scalar()
        scaled = sides.withColumn("_base", mean)
    else:
        scaled = sides.join(avg.select("match_id", both.alias("_base")), "match_id")
    cols = []
    for p in ("h", "a"):
        for w in windows:
            cols.append(F.try_divide(f"{p}_goals_scored_avg{w}", "_base").alias(f"{p}_attack_ratio{w}"))
            cols.append(F.try_divide(f"{p}_goals_conceded_avg{w}", "_base").alias(f"{p}_defence_ratio{w}"))
    return scaled.select("match_id", *cols)


def extended_form(
    matches: DataFrame,
    windows: tuple[int, ...] = (3, 5, 10, 20),
    context: str = "overall",
    metrics: dict[str, str] | None = None,
    per_league: bool = True,
    unit: str = "year",
) -> DataFrame:
    """Extended form metrics per team (and league) in one context: overall, or the own venue.

    With context `venue` a home row sees the team's earlier home games and an away row its away
    games; the other venue's columns are null by definition and therefore not produced.
    """
    keys = ["team", *(["league"] if per_league else []), *(["is_home"] if context == "venue" else [])]
    return rolling(
        team_game_log(matches), metrics or EXTENDED_METRICS, windows, keys, name=context + "_{metric}_avg{w}", unit=unit
    )


def venue_form_asof(
    matches: DataFrame, metrics: dict[str, str], window: int = 5, per_league: bool = True, unit: str = "year"
) -> DataFrame:
    """Form at both venues before every game, whichever venue the game itself is at.

    Every team-game is asked twice, once for each venue; only games played at that venue have a
    value, so the mean of the last `window` values is found among non-null rows.
    """
    log = team_game_log(matches)
    keys = ["team", *(["league"] if per_league else [])]
    played = log
    for side, label in ((1, "home"), (0, "away")):
        past = with_asof(
            log.filter(F.col("is_home") == side),
            keys,
            ORDER,
            {f"_{m}": Trailing(F.expr(e), window - 1, "sum") for m, e in metrics.items()}
            | {"_n": Trailing(F.lit(1), window - 1, "count")},
            unit,
        )
        after = past.select(
            *keys,
            *ORDER,
            *[
                ((F.coalesce(F.col(f"_{m}"), F.lit(0)) + F.expr(e)) / (F.col("_n") + 1)).alias(f"{label}_{m}_avg{window}")
                for m, e in metrics.items()
            ],
        )
        names = [f"{label}_{m}_avg{window}" for m in metrics]
        played = as_of_values(played, after, keys, ORDER, names, unit)
    return played


def as_of_values(
    left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str], unit: str = "year",
    inclusive: bool = False,
) -> DataFrame:
    """Attach to each left row the values of the latest right row earlier in `order`.

    Both sides are stacked and the last right row is carried forward. A right row at the same
    position counts only when `inclusive` is set.
    """
    packed = F.struct(*order, *values)
    l_rows = left.withColumn("_kind", F.lit(2 if inclusive else 0)).withColumn("_at", F.lit(None).cast(right.select(packed).schema[0].dataType))
    r_rows = right.select(*keys, *order, F.lit(1).alias("_kind"), packed.alias("_at"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    out = with_asof(both, keys, [*order, "_kind"], {"_last": Expanding(F.col("_at"), "max")}, unit)
    return out.filter("_kind <> 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])
