"""Time-series features: form, head-to-head, schedule, league table, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import form, history, splits
from touchline.plans import inputs
from touchline.plans.common import rounded, rsql
from touchline.plans.registry import query

TG = ["match_id", "team", "is_home"]
TGW = inputs.sql_with("team_games")
MW = inputs.sql_with("matches")


def _past(keys: str, w: int) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY match_date, match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def _all_past(keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"OVER ({part}ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "team_game_log",
    "3.14 5.1 5.11 2.51",
    TGW + "SELECT match_id, team, opponent, is_home, scored, conceded, points, xg, xga FROM team_games",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.team_games(spark, sf).select(
        "match_id", "team", "opponent", "is_home", "scored", "conceded", "points", "xg", "xga"
    )


_FORM = {**form.FORM_METRICS, "goal_diff": "scored - conceded"}
_FORM_COLS = {f"{m}_avg{w}": f"avg({e}) {_past('team', w)}" for m, e in _FORM.items() for w in (5, 10)}


@query("form_rolling", "5.2 5.3", TGW + f"SELECT match_id, team, is_home, {rsql(_FORM_COLS)} FROM team_games")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(form.rolling_form(inputs.matches(spark, sf), (5, 10)), TG, list(_FORM_COLS))


_MR = {"points_avg5": "points", "goals_scored_avg5": "scored"}


@query(
    "form_match_rows",
    "3.14 5.3",
    TGW
    + ", f AS (SELECT match_id, is_home, "
    + ", ".join(f"avg({e}) {_past('team', 5)} AS {n}" for n, e in _MR.items())
    + " FROM team_games) SELECT h.match_id, "
    + rsql({f"h_{n}": f"h.{n}" for n in _MR} | {f"a_{n}": f"a.{n}" for n in _MR})
    + " FROM f h JOIN f a ON a.match_id = h.match_id AND a.is_home = 0 WHERE h.is_home = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = form.rolling_form(inputs.matches(spark, sf), (5,))
    out = form.to_match_rows(f, list(_MR))
    return rounded(out, ["match_id"], [f"{p}_{n}" for p in "ha" for n in _MR])


_EWM = {"points_ewm": ("points", 5), "btts_ewm": ("CAST(scored > 0 AND conceded > 0 AS INT)", 5), "goal_diff_ewm10": ("scored - conceded", 10)}


@query(
    "form_ewm",
    "5.2 5.3",
    TGW
    + ", n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS i FROM team_games) SELECT match_id, team, is_home, "
    + rsql(
        {
            n: f"sum(({e}) * pow(2e0, i / {h}e0)) {_all_past('team')} / sum(pow(2e0, i / {h}e0)) {_all_past('team')}"
            for n, (e, h) in _EWM.items()
        }
    )
    + " FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(form.rolling_form_ewm(inputs.matches(spark, sf)), TG, list(_EWM))


@query(
    "form_win_rates",
    "5.3",
    TGW
    + f""", w AS (SELECT *, sum(CAST(points = 3 AND is_home = 1 AS INT)) {_all_past('team')} AS hw,
 sum(CAST(points = 3 AND is_home = 0 AS INT)) {_all_past('team')} AS aw, sum(is_home) {_all_past('team')} AS hm,
 sum(1 - is_home) {_all_past('team')} AS am, avg(CAST(points = 3 AS INT)) {_all_past('team')} AS wo,
 lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id) AS prev,
 row_number() OVER (PARTITION BY team, season ORDER BY match_date, match_id) - 1 AS ms FROM team_games)
SELECT match_id, team, is_home, CAST(hm AS BIGINT) AS home_matches, CAST(am AS BIGINT) AS away_matches,
 CAST(datediff('day', prev, match_date) AS INT) AS days_since_last_match, CASE WHEN ms > 0 THEN ms END AS matches_this_season,
 {rsql({'win_rate_home': 'coalesce(hw / nullif(hm, 0), 0)', 'win_rate_away': 'coalesce(aw / nullif(am, 0), 0)', 'win_rate_overall': 'wo'})} FROM w""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = form.win_rates(inputs.matches(spark, sf))
    keep = [*TG, "home_matches", "away_matches", "days_since_last_match", "matches_this_season"]
    return rounded(out, keep, ["win_rate_home", "win_rate_away", "win_rate_overall"])


_AVG_SQL = (
    TGW
    + f""", e AS (SELECT match_id, avg(scored) {_all_past('team')} AS s, avg(conceded) {_all_past('team')} AS c FROM team_games),
la AS (SELECT match_id, coalesce(avg(s), 1) AS ls, coalesce(avg(c), 1) AS lc FROM e GROUP BY match_id)"""
)


@query(
    "running_average_goals",
    "5.4",
    _AVG_SQL + " SELECT match_id, " + rsql({"league_avg_goals_scored": "ls", "league_avg_goals_conceded": "lc"}) + " FROM la",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        form.running_average(inputs.matches(spark, sf)), ["match_id"], ["league_avg_goals_scored", "league_avg_goals_conceded"]
    )


_RATIO = ["h_attack_ratio5", "h_defence_ratio5", "a_attack_ratio5", "a_defence_ratio5"]


def _ratio_sql(base: str) -> str:
    parts = {}
    for p in "ha":
        parts[f"{p}_attack_ratio5"] = f"max(CASE WHEN is_home = {int(p == 'h')} THEN gs END) / {base}"
        parts[f"{p}_defence_ratio5"] = f"max(CASE WHEN is_home = {int(p == 'h')} THEN gc END) / {base}"
    return (
        _AVG_SQL
        + f""", f AS (SELECT match_id, is_home, avg(scored) {_past('team', 5)} AS gs, avg(conceded) {_past('team', 5)} AS gc FROM team_games),
g AS (SELECT (avg(ls) + avg(lc)) / 2 AS m FROM la)
SELECT f.match_id, {rsql(parts)} FROM f JOIN la ON la.match_id = f.match_id GROUP BY f.match_id"""
    )


@query("attack_defence_ratio_global", "5.5", _ratio_sql("(SELECT m FROM g)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(form.attack_defence_ratios(inputs.matches(spark, sf)), ["match_id"], _RATIO)


@query("attack_defence_ratio_asof", "5.5", _ratio_sql("nullif(max((ls + lc) / 2), 0)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(form.attack_defence_ratios(inputs.matches(spark, sf), denominator="asof"), ["match_id"], _RATIO)


_EXT = {f"overall_{m}_avg{w}": f"avg({e}) {_past('team, league', w)}" for m, e in form.EXTENDED_METRICS.items() for w in (3, 5, 10, 20)}


@query("extended_form_overall", "5.10 5.12 5.19", TGW + f"SELECT match_id, team, is_home, {rsql(_EXT)} FROM team_games")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(form.extended_form(inputs.matches(spark, sf)), TG, list(_EXT))


_VEN = {f"venue_{m}_avg{w}": f"avg({e}) {_past('team, league, is_home', w)}" for m, e in form.EXTENDED_METRICS.items() for w in (3, 10)}


@query("extended_form_venue", "5.10 5.12", TGW + f"SELECT match_id, team, is_home, {rsql(_VEN)} FROM team_games")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(form.extended_form(inputs.matches(spark, sf), (3, 10), "venue"), TG, list(_VEN))


@query(
    "extended_form_venue_asof",
    "5.10",
    TGW
    + """, s AS (SELECT t.match_id, t.team, t.is_home, p.points, p.is_home AS venue, row_number() OVER (PARTITION BY t.match_id, t.team, p.is_home
 ORDER BY p.match_date DESC, p.match_id DESC) AS rn FROM team_games t JOIN team_games p ON p.team = t.team
 AND (p.match_date, p.match_id) < (t.match_date, t.match_id)),
a AS (SELECT match_id, team, avg(CASE WHEN venue = 1 THEN points END) AS hp, avg(CASE WHEN venue = 0 THEN points END) AS ap FROM s WHERE rn <= 5 GROUP BY 1, 2)
SELECT t.match_id, t.team, t.is_home, round(hp, 6) AS home_points_avg5, round(ap, 6) AS away_points_avg5
FROM team_games t LEFT JOIN a ON a.match_id = t.match_id AND a.team = t.team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = form.venue_form_asof(inputs.matches(spark, sf), {"points": "points"}, 5, per_league=False)
    return rounded(out, TG, ["home_points_avg5", "away_points_avg5"])


_XG = {f"{m}_avg{w}": f"avg({e}) {_past('team', w)}" for m, e in {"xg": "xg", "xga": "xga", "xgd": "xg - xga"}.items() for w in (5, 10)}


@query("xg_rolling", "5.19", TGW + f"SELECT match_id, team, is_home, {rsql(_XG)} FROM team_games")
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.team_games(spark, sf)
    return rounded(form.rolling(log, {"xg": "xg", "xga": "xga", "xgd": "xg - xga"}, (5, 10), ["team"]), TG, list(_XG))


_STAT = {f"{m}_roll{w}": f"avg({m}) {_past('team', w)}" for m in ("shots", "sot", "xg") for w in (3, 8)}


@query("team_stats_rolling", "5.30", TGW + f"SELECT match_id, team, is_home, {rsql(_STAT)} FROM team_games")
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.team_games(spark, sf)
    out = form.rolling(log, {m: m for m in ("shots", "sot", "xg")}, (3, 8), ["team"], name="{metric}_roll{w}")
    return rounded(out, TG, list(_STAT))


_H2H = {
    "home_points_avg": "avg(CASE result WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END)",
    "away_points_avg": "avg(CASE result WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END)",
    "total_goals_avg": "avg(home_goals + away_goals)",
    "home_win_rate": "avg(CAST(result = 'H' AS INT))",
    "home_goals_avg": "avg(home_goals)",
    "away_goals_avg": "avg(away_goals)",
}


@query(
    "h2h_ordered_pair",
    "5.6 5.14",
    MW
    + f"SELECT match_id, count(*) {_all_past('home_team, away_team')} AS matches_played, "
    + rsql({n: f"{e} {_past('home_team, away_team', 6)}" for n, e in _H2H.items()})
    + " FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.ordered_pair_h2h(inputs.matches(spark, sf)), ["match_id", "matches_played"], list(_H2H))


@query(
    "h2h_ordered_pair_all",
    "5.6",
    MW
    + f"SELECT match_id, count(*) {_all_past('home_team, away_team')} AS matches_played, "
    + rsql({n: f"{e} {_all_past('home_team, away_team')}" for n, e in _H2H.items()})
    + " FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = history.ordered_pair_h2h(inputs.matches(spark, sf), window=0)
    return rounded(out, ["match_id", "matches_played"], list(_H2H))


def _dir(context: str, keys: str) -> dict[str, str]:
    return {f"h2h_{context}_{m}_last{w}": f"avg({e}) {_past(keys, w)}" for m, e in history.H2H_METRICS.items() for w in (3, 5, 10)}


@query(
    "h2h_directed_pair",
    "5.13 5.14",
    TGW + f"SELECT match_id, team, is_home, {rsql(_dir('overall', 'team, opponent'))} FROM team_games",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.directed_pair_h2h(inputs.matches(spark, sf)), TG, list(_dir("overall", "")))


@query(
    "h2h_directed_pair_venue",
    "5.13",
    TGW + f"SELECT match_id, team, is_home, {rsql(_dir('venue', 'team, opponent, is_home'))} FROM team_games",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.directed_pair_h2h(inputs.matches(spark, sf), context="venue"), TG, list(_dir("venue", "")))


_OU_H2H = {"total_goals": "home_goals + away_goals", "over25_rate": "CAST(home_goals + away_goals > 2.5 AS INT)"}
_BTTS_H2H = {
    "btts_rate": "CAST(home_goals > 0 AND away_goals > 0 AS INT)",
    "home_scored_rate": "CAST(home_goals > 0 AS INT)",
    "away_scored_rate": "CAST(away_goals > 0 AS INT)",
}


def _pair_sql(values: dict[str, str]) -> str:
    w = _past("least(home_team, away_team), greatest(home_team, away_team)", 5)
    return (
        MW
        + "SELECT match_id, "
        + rsql({f"h2h_{n}_last_5": f"coalesce(avg({e}) {w}, (SELECT avg({e}) FROM matches))" for n, e in values.items()})
        + " FROM matches"
    )


def _pair(spark: SparkSession, sf: str, values: dict[str, str]) -> DataFrame:
    out = history.unordered_pair_h2h(inputs.matches(spark, sf), {n: F.expr(e) for n, e in values.items()})
    return rounded(out, ["match_id"], [f"h2h_{n}_last_5" for n in values])


@query("h2h_unordered_goals", "5.25", _pair_sql(_OU_H2H))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _pair(spark, sf, _OU_H2H)


@query("h2h_unordered_btts", "5.28", _pair_sql(_BTTS_H2H))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _pair(spark, sf, _BTTS_H2H)


@query(
    "schedule_rest",
    "5.15 2.39",
    TGW
    + """SELECT match_id, team, is_home, CAST(datediff('day', lag(match_date) OVER w, match_date) AS INT) AS rest_days,
 CAST(coalesce(opponent = lag(opponent) OVER w, FALSE) AS INT) AS is_back_to_back,
 CAST(datediff('day', lag(match_date) OVER w, match_date) AS INT) AS days_since_competition
FROM team_games WINDOW w AS (PARTITION BY team, league ORDER BY match_date, match_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return history.schedule(inputs.matches(spark, sf)).select(*TG, "rest_days", "is_back_to_back", "days_since_competition")


@query(
    "schedule_rest_all_leagues",
    "5.15",
    TGW
    + """SELECT match_id, team, is_home, CAST(datediff('day', lag(match_date) OVER w, match_date) AS INT) AS rest_days,
 CAST(coalesce(opponent = lag(opponent) OVER w, FALSE) AS INT) AS is_back_to_back,
 CAST(datediff('day', lag(match_date) OVER c, match_date) AS INT) AS days_since_competition
FROM team_games WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id),
 c AS (PARTITION BY team, league ORDER BY match_date, match_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = history.schedule(inputs.matches(spark, sf), per_league=False)
    return out.select(*TG, "rest_days", "is_back_to_back", "days_since_competition")


@query(
    "schedule_recent_matches",
    "5.16",
    TGW
    + """SELECT match_id, team, is_home, count(*) OVER d7 - 1 - (SELECT count(*) FROM team_games s WHERE s.team = t.team
  AND s.match_date = t.match_date AND s.match_id > t.match_id) AS matches_last_7_days,
 count(*) OVER d14 - 1 - (SELECT count(*) FROM team_games s WHERE s.team = t.team
  AND s.match_date = t.match_date AND s.match_id > t.match_id) AS matches_last_14_days
FROM team_games t WINDOW d7 AS (PARTITION BY team ORDER BY match_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),
 d14 AS (PARTITION BY team ORDER BY match_date RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return history.recent_match_counts(inputs.matches(spark, sf)).select(*TG, "matches_last_7_days", "matches_last_14_days")


@query(
    "schedule_venue_streaks",
    "5.17",
    TGW
    + """, c AS (SELECT *, CASE WHEN is_home = lag(is_home) OVER w THEN 0 ELSE 1 END AS chg FROM team_games
 WINDOW w AS (PARTITION BY team, league ORDER BY match_date, match_id)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY team, league ORDER BY match_date, match_id) AS isl FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY team, league, isl ORDER BY match_date, match_id) - 1 AS pos FROM i)
SELECT match_id, team, is_home, CASE WHEN is_home = 1 AND pos > 0 THEN pos END AS consec_home,
 CASE WHEN is_home = 0 AND pos > 0 THEN pos END AS consec_away FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return history.venue_streaks(inputs.matches(spark, sf)).select(*TG, "consec_home", "consec_away")


# Every nation stands for a club ground; its position follows from its key.
_VENUE = "n_name AS team, -60e0 + (n_nationkey * 7) % 120 AS lat, -170e0 + (n_nationkey * 13) % 340 AS lon"


@query(
    "schedule_travel",
    "5.18 2.29",
    TGW
    + f""", v AS (SELECT {_VENUE} FROM nation),
l AS (SELECT t.*, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM team_games t
 JOIN v ON v.team = CASE WHEN is_home = 1 THEN t.team ELSE t.opponent END
 WINDOW w AS (PARTITION BY t.team ORDER BY match_date, match_id)),
h AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS a FROM l)
SELECT match_id, team, is_home, round(CASE WHEN 12742e0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))) < 20000 THEN 12742e0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))) END, 4) AS travel_distance FROM h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    venues = inputs.table(spark, sf, "nation").selectExpr(*[s.strip() for s in _VENUE.split(", ")])
    return rounded(history.travel_distance(inputs.matches(spark, sf), venues), TG, ["travel_distance"], 4)


@query(
    "league_positions",
    "5.7",
    TGW
    + """, ev AS (SELECT match_id, match_date, season, league, team, points, scored - conceded AS gd FROM team_games),
st AS (SELECT m.match_id, m.season, m.league, m.home_team, m.away_team, e.team, sum(e.points) AS pts, sum(e.gd) AS gd, count(*) AS n
 FROM matches m JOIN ev e ON e.season = m.season AND e.league = m.league AND (e.match_date, e.match_id) < (m.match_date, m.match_id)
 GROUP BY ALL),
al AS (SELECT * FROM st
 UNION ALL SELECT match_id, season, league, home_team, away_team, home_team, 0, 0, 0 FROM matches m
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.match_id = m.match_id AND st.team = m.home_team)
 UNION ALL SELECT match_id, season, league, home_team, away_team, away_team, 0, 0, 0 FROM matches m
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.match_id = m.match_id AND st.team = m.away_team)),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pts DESC, gd DESC, team) AS pos FROM al)
SELECT match_id, max(pos) FILTER (team = home_team) AS league_position, CAST(max(pts) FILTER (team = home_team) AS BIGINT) AS points_total,
 CAST(max(n) FILTER (team = home_team) AS BIGINT) AS matches_played_league, max(pos) FILTER (team = away_team) AS away_league_position,
 CAST(max(pts) FILTER (team = away_team) AS BIGINT) AS away_points_total, CAST(max(n) FILTER (team = away_team) AS BIGINT) AS away_matches_played_league
FROM rk GROUP BY match_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return history.league_positions(inputs.matches(spark, sf))


@query(
    "target_encode_expanding",
    "5.8",
    MW
    + f"SELECT match_id, round(coalesce(avg(CAST(result = 'H' AS INT)) {_all_past('home_team')}, 0.45), 6) AS home_team_te FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = history.target_encode_expanding(
        inputs.matches(spark, sf), "home_team", (F.col("result") == "H").cast("int"), 0.45, "home_team_te"
    )
    return rounded(out, ["match_id"], ["home_team_te"])


_OU = {
    "goals_scored": "scored", "goals_conceded": "conceded", "total_goals": "scored + conceded",
    "over25": "CAST(scored + conceded > 2.5 AS INT)", "over35": "CAST(scored + conceded > 3.5 AS INT)",
    "btts": "CAST(scored > 0 AND conceded > 0 AS INT)", "xg_for": "xg", "xg_against": "xga", "shots_for": "shots",
}
_BTTS = {
    "scored": "CAST(scored > 0 AS INT)", "clean_sheet": "CAST(conceded = 0 AS INT)",
    "btts": "CAST(scored > 0 AND conceded > 0 AS INT)", "goals_scored": "scored", "goals_conceded": "conceded",
}


def _min2(e: str, keys: str, w: int) -> str:
    return f"CASE WHEN count({e}) {_past(keys, w)} >= 2 THEN avg({e}) {_past(keys, w)} END"


def _market_sql(metrics: dict[str, str]) -> str:
    cols = {f"rolling_{m}_{w}": _min2(e, "team", w) for m, e in metrics.items() for w in (5, 10, 20)}
    cols |= {f"cumavg_{m}": f"avg({e}) {_all_past('team')}" for m, e in metrics.items()}
    return TGW + f"SELECT match_id, team, is_home, {rsql(cols, off_tie=True)} FROM team_games"


def _market_rolling(spark: SparkSession, sf: str, metrics: dict[str, str]) -> DataFrame:
    from touchline.operators.market_features import market_rolling

    out = market_rolling(form.team_game_log(inputs.matches(spark, sf)), metrics)
    return rounded(out, TG, [c for c in out.columns if c.startswith(("rolling_", "cumavg_"))], off_tie=True)


@query("over_under_rolling", "5.23", _market_sql(_OU))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _market_rolling(spark, sf, _OU)


@query("btts_rolling", "5.27", _market_sql(_BTTS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _market_rolling(spark, sf, _BTTS)


@query(
    "over_under_match_diffs",
    "5.24",
    TGW
    + ", f AS (SELECT match_id, is_home, "
    + ", ".join(f"{_min2(e, 'team', 5)} AS {n}" for n, e in {"gs": "scored", "gc": "conceded", "tg": "scored + conceded"}.items())
    + " FROM team_games) SELECT h.match_id, "
    + rsql({"diff_att_def_5": "h.gs - a.gc", "diff_def_att_5": "a.gs - h.gc", "expected_total_goals_5": "(h.tg + a.tg) / 2"})
    + " FROM f h JOIN f a ON a.match_id = h.match_id AND a.is_home = 0 WHERE h.is_home = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.market_features import over_under_diffs

    out = over_under_diffs(inputs.matches(spark, sf), (5,))
    return rounded(out, ["match_id"], ["diff_att_def_5", "diff_def_att_5", "expected_total_goals_5"])


@query(
    "over_under_league_rates",
    "5.26",
    MW
    + "SELECT match_id, "
    + rsql(
        {
            "league_avg_total_goals": f"coalesce(avg(home_goals + away_goals) {_all_past('league')}, 2.5)",
            "league_over25_rate": f"coalesce(avg(CAST(home_goals + away_goals > 2.5 AS INT)) {_all_past('league')}, 0.45)",
        }
    )
    + " FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("home_goals") + F.col("away_goals")
    out = history.expanding_rates(
        inputs.matches(spark, sf),
        ["league"],
        {"league_avg_total_goals": (total, 2.5), "league_over25_rate": ((total > 2.5).cast("int"), 0.45)},
    )
    return rounded(out, ["match_id"], ["league_avg_total_goals", "league_over25_rate"])


@query(
    "over_under_season_average",
    "5.26",
    MW
    + f"SELECT match_id, round(coalesce(avg(home_goals + away_goals) {_all_past('league, season')}, 1.5), 6) AS season_avg_total_goals FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("home_goals") + F.col("away_goals")
    out = history.expanding_rates(inputs.matches(spark, sf), ["league", "season"], {"season_avg_total_goals": (total, 1.5)})
    return rounded(out, ["match_id"], ["season_avg_total_goals"])


@query(
    "btts_league_rate",
    "5.29",
    MW
    + f"SELECT match_id, round(coalesce(avg(CAST(home_goals > 0 AND away_goals > 0 AS INT)) {_all_past('league')}, 0.5), 6) AS league_btts_rate FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = F.expr("CAST(home_goals > 0 AND away_goals > 0 AS INT)")
    out = history.expanding_rates(inputs.matches(spark, sf), ["league"], {"league_btts_rate": (both, 0.5)})
    return rounded(out, ["match_id"], ["league_btts_rate"])


_NUM = MW + ", n AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) - 1 AS i, count(*) OVER () AS n FROM matches)"


@query(
    "split_chronological",
    "5.31",
    _NUM
    + """, c AS (SELECT *, CAST(ceil(n * 0.15e0) AS BIGINT) AS t FROM n), v AS (SELECT *, CAST(ceil((n - t) * (0.15e0 / 0.85e0)) AS BIGINT) AS v FROM c)
SELECT match_id, CASE WHEN i < n - t - v THEN 'train' WHEN i < n - t THEN 'val' ELSE 'test' END AS split FROM v""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return splits.chronological_split(inputs.matches(spark, sf), form.ORDER, (0.70, 0.15, 0.15)).select("match_id", "split")


@query(
    "split_date_ranges",
    "5.32",
    MW
    + """SELECT match_id, CASE WHEN match_date < DATE '1999-01-01' THEN 'train' WHEN match_date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split
FROM matches WHERE match_date >= DATE '1995-01-01' AND match_date < DATE '2001-01-01'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.date_split(
        inputs.matches(spark, sf), "match_date", ("1995-01-01", "1999-01-01"), ("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-01-01")
    )
    return out.select("match_id", "split")


@query(
    "folds_expanding",
    "5.33",
    _NUM
    + """, f AS (SELECT match_id, i, n, fold, n // 6 AS s, n - (5 - fold + 1) * (n // 6) AS st FROM n, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) k)
SELECT match_id, CAST(fold AS INT) AS fold, CASE WHEN i < st - 10 THEN 'train' ELSE 'val' END AS role FROM f WHERE i < st - 10 OR (i >= st AND i < st + s)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return splits.expanding_folds(inputs.matches(spark, sf), form.ORDER, 5, gap=10).select("match_id", "fold", "role")


@query(
    "folds_sliding",
    "5.34",
    _NUM
    + """, f AS (SELECT unnest(range(0, (SELECT (max(n) - 1000) // 500 FROM n) + 1)) AS k)
SELECT match_id, CAST(k + 1 AS BIGINT) AS fold, CASE WHEN i < k * 500 + 800 THEN 'train' ELSE 'val' END AS role
FROM n JOIN f ON i >= k * 500 AND i < k * 500 + 1000""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sliding_folds(inputs.matches(spark, sf), form.ORDER, 800, 200, 500).select("match_id", "fold", "role")


@query(
    "folds_walk_forward",
    "5.35",
    _NUM
    + """, f AS (SELECT unnest(range(1, (SELECT (max(n) - 700) // 350 FROM n) + 1)) AS k)
SELECT k AS fold, count(*) FILTER (i < 700 + (k - 1) * 350) AS train_size, count(*) FILTER (i >= 700 + (k - 1) * 350) AS val_size
FROM n JOIN f ON i < 700 + k * 350 GROUP BY k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.matches(spark, sf).select(*form.ORDER)
    return splits.fold_sizes(splits.walk_forward_folds(rows, form.ORDER, 700, 350, spans=True))


@query(
    "expected_goal_columns",
    "5.20",
    MW
    + "SELECT match_id, round(home_xg, 6) AS home_xg, round(away_xg, 6) AS away_xg, true AS known FROM matches UNION ALL SELECT match_id, 0e0, 0e0, false FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    named = m.select("match_id", F.col("home_xg").alias("xG_Home"), F.col("away_xg").alias("AxG"))
    parts = [form.with_expected_goals(d) for d in (named, m.select("match_id", F.col("home_xg").alias("hxg")))]
    both = [rounded(d, ["match_id"], ["home_xg", "away_xg"]).withColumn("known", F.lit(known)) for d, known in parts]
    return both[0].unionByName(both[1])
