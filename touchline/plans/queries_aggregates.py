"""League, team, squad and summary aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import aggregates as agg
from touchline.operators import squad
from touchline.plans import inputs
from touchline.plans.common import rounded, rsql
from touchline.plans.registry import query

MW = inputs.sql_with("matches")
TGW = inputs.sql_with("team_games")
PLW = inputs.sql_with("players")

_STRENGTH = {
    "avg_home_goals": "avg(home_goals)",
    "avg_away_goals": "avg(away_goals)",
    "avg_goals": "avg(home_goals + away_goals)",
    "offensive_strength": "(avg(home_goals) + avg(away_goals)) / 2",
    "defensive_strength": "(avg(home_goals) + avg(away_goals)) / 2",
    "std_goal_diff": "stddev_samp(home_goals - away_goals)",
    "home_adv": "avg(home_goals) - avg(away_goals)",
    "home_win_rate": "avg(CAST(result = 'H' AS INT))",
    "draw_rate": "avg(CAST(result = 'D' AS INT))",
    "away_win_rate": "avg(CAST(result = 'A' AS INT))",
    "btts_rate": "avg(CAST(home_goals > 0 AND away_goals > 0 AS INT))",
    "over_2_5_rate": "avg(CAST(home_goals + away_goals > 2.5 AS INT))",
    "avg_xg": "(sum(home_xg) + sum(away_xg)) / (count(home_xg) + count(away_xg))",
}


@query(
    "group_by_generic",
    "4.1",
    MW
    + """SELECT league, season, count(match_id) AS n, CAST(sum(home_goals) AS BIGINT) AS goals, round(avg(home_xg), 6) AS xg,
 min(match_date) AS first_date, max(away_goals) AS most FROM matches GROUP BY league, season""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.aggregate(
        inputs.matches(spark, sf),
        ["league", "season"],
        {
            "n": ("match_id", "count"), "goals": ("home_goals", "sum"), "xg": ("home_xg", "mean"),
            "first_date": ("match_date", "min"), "most": ("away_goals", "max"),
        },
    )
    return out.withColumn("xg", F.round("xg", 6))


@query(
    "league_strength",
    "4.2",
    MW
    + f"SELECT season, league, count(home_goals) AS total_matches, {rsql(_STRENGTH)} FROM matches GROUP BY season, league HAVING count(*) >= 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.league_strength(inputs.matches(spark, sf)), ["season", "league", "total_matches"], list(_STRENGTH))


@query(
    "league_strength_normalised",
    "4.3",
    MW
    + """, s AS (SELECT season, league, (avg(home_goals) + avg(away_goals)) / 2 AS o FROM matches GROUP BY ALL HAVING count(*) >= 20),
r AS (SELECT greatest(avg(o), 0.01) AS r FROM s WHERE league = 'EUROPE')
SELECT season, league, round(o / r, 6) AS attack_factor, round(o / r, 6) AS defence_factor FROM s, r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.normalise_leagues(agg.league_strength(inputs.matches(spark, sf)), "EUROPE")
    return rounded(out, ["season", "league"], ["attack_factor", "defence_factor"])


@query(
    "league_strength_european",
    "4.4",
    MW
    + f""", flag AS (SELECT season, league, home_team AS team FROM matches GROUP BY ALL HAVING avg(home_goals) > 2.1),
t AS (SELECT *, EXISTS (SELECT 1 FROM flag f WHERE f.season = m.season AND f.league = m.league AND f.team IN (m.home_team, m.away_team)) AS hit FROM matches m),
u AS (SELECT *, 'with_european' AS type FROM t UNION ALL SELECT *, 'without_european' FROM t WHERE NOT hit)
SELECT season, league, type, count(*) AS total_matches, {rsql(_STRENGTH)} FROM u GROUP BY ALL HAVING count(*) >= 20""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    flagged = (
        m.groupBy("season", "league", F.col("home_team").alias("team")).agg(F.avg("home_goals").alias("g")).filter("g > 2.1")
    )
    out = agg.european_adjustment(m, flagged)
    return rounded(out, ["season", "league", "type", "total_matches"], list(_STRENGTH))


# A team belongs to the league where it played most often in the season.
_HOME_LEAGUE = """, lc AS (SELECT team, season, league, count(*) AS n FROM team_games GROUP BY ALL),
ts AS (SELECT team, season, league FROM lc QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY n DESC, league) = 1)"""


def _main_league(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.team_games(spark, sf).groupBy("team", "season", "league").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), "league")).alias("b")
    return c.groupBy("team", "season").agg(best).select("team", "season", F.col("b.league").alias("league"))


# The same with a league that changes with the season, so teams move.
_MOVING_LEAGUE = """, ts AS (SELECT DISTINCT team, season, CASE (season + length(team)) % 5 WHEN 0 THEN 'EUROPE' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'AFRICA' ELSE 'MIDDLE EAST' END AS league FROM team_games)"""


def _moving_league(spark: SparkSession, sf: str) -> DataFrame:
    step = (F.col("season") + F.length("team")) % 5
    league = F.when(step == 0, "EUROPE").when(step == 1, "AMERICA").when(step == 2, "ASIA").when(step == 3, "AFRICA").otherwise("MIDDLE EAST")
    return inputs.team_games(spark, sf).select("team", "season", league.alias("league")).distinct()


_BY_TIER = """, t AS (SELECT *, CASE league WHEN 'EUROPE' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END AS tier FROM ts WHERE league IN ('EUROPE', 'AMERICA', 'ASIA', 'AFRICA')),
n AS (SELECT season, lead(season) OVER (ORDER BY season) AS nxt FROM (SELECT DISTINCT season FROM ts)),
p AS (SELECT t.*, nxt FROM t JOIN n USING (season) WHERE nxt IS NOT NULL),
c AS (SELECT t.*, n.season AS before FROM t JOIN n ON n.nxt = t.season)
SELECT coalesce(c.season, p.nxt) AS season, coalesce(p.season, c.before) AS prev_season, coalesce(c.team, p.team) AS team, c.league, p.league AS prev_league,
 CASE WHEN p.team IS NULL THEN 'joined' WHEN c.team IS NULL THEN 'left' WHEN c.tier < p.tier THEN 'promoted' ELSE 'relegated' END AS move
FROM c FULL JOIN p ON p.nxt = c.season AND p.team = c.team WHERE p.team IS NULL OR c.team IS NULL OR c.tier <> p.tier"""
_JOINED_LEFT = """, n AS (SELECT season, lead(season) OVER (ORDER BY season) AS nxt FROM (SELECT DISTINCT season FROM ts)),
p AS (SELECT ts.team, ts.league, n.nxt AS season FROM ts JOIN n USING (season) WHERE n.nxt IS NOT NULL),
c AS (SELECT team, league, season FROM ts WHERE season IN (SELECT nxt FROM n))
SELECT *, 'joined' AS move FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'left' FROM (SELECT * FROM p EXCEPT SELECT * FROM c)"""
_TIERS = {"all": ["EUROPE", "AMERICA", "ASIA", "AFRICA"]}


def _joined_left(team_seasons: DataFrame) -> DataFrame:
    return agg.promotions(team_seasons).select("team", F.coalesce("league", "prev_league").alias("league"), "season", "move")


@query("promotions_by_tier", "4.5 11.11", TGW + _HOME_LEAGUE + _BY_TIER)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.promotions(_main_league(spark, sf), _TIERS).drop("grp")


@query("promotions_moving_teams", "4.5 11.11", TGW + _MOVING_LEAGUE + _BY_TIER)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.promotions(_moving_league(spark, sf), _TIERS).drop("grp")


@query("promotions_joined_left", "4.5 11.11", TGW + _HOME_LEAGUE + _JOINED_LEFT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_left(_main_league(spark, sf))


@query("promotions_joined_left_moving_teams", "4.5 11.11", TGW + _MOVING_LEAGUE + _JOINED_LEFT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_left(_moving_league(spark, sf))


@query(
    "team_league_mode",
    "4.6",
    TGW
    + "SELECT team, league, n FROM (SELECT team, league, count(*) AS n FROM team_games GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, league) = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.team_league_mode(inputs.matches(spark, sf))


_TABLE = """count(*) AS played, count(*) FILTER (points = 3) AS wins, count(*) FILTER (points = 1) AS draws, count(*) FILTER (points = 0) AS losses,
 CAST(sum(scored) AS BIGINT) AS goals_for, CAST(sum(conceded) AS BIGINT) AS goals_against, CAST(sum(points) AS BIGINT) AS points"""


@query("standings", "4.7 14.16", TGW + f"SELECT season, league, team, {_TABLE} FROM team_games GROUP BY season, league, team")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.standings(inputs.matches(spark, sf))


@query("standings_rollup", "4.7", TGW + f"SELECT team, league, season, {_TABLE} FROM team_games GROUP BY ROLLUP (team, league, season)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.standings_rollup(inputs.matches(spark, sf))


@query(
    "model_performance",
    "4.8",
    inputs.sql_with("matches", "preds")
    + """SELECT model, count(*) AS total_predictions, round(avg(CAST(CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END = result AS INT)), 4) AS accuracy,
 round(avg(greatest(p_h, p_d, p_a)), 4) AS avg_confidence,
 round(avg(pow(CAST(result = 'H' AS INT) - p_h, 2) + pow(CAST(result = 'D' AS INT) - p_d, 2) + pow(CAST(result = 'A' AS INT) - p_a, 2)), 6) AS brier_score,
 round(avg(-log2(greatest(CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END, 0.001))), 6) AS log_loss
FROM preds JOIN matches USING (match_id) GROUP BY model""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.model_performance(inputs.preds(spark, sf, ("result",)))
    return out.select(
        "model", "total_predictions", F.round("accuracy", 4).alias("accuracy"), F.round("avg_confidence", 4).alias("avg_confidence"),
        F.round("brier_score", 6).alias("brier_score"), F.round("log_loss", 6).alias("log_loss"),
    )


@query(
    "poisson_strengths",
    "4.9 2.28 2.27",
    MW
    + """, w AS (SELECT *, pow(2e0, -greatest(datediff('day', match_date, (SELECT max(match_date) FROM matches) + 1), 0) / 365e0) AS w FROM matches),
g AS (SELECT home_team AS team, w, home_goals AS s, away_goals AS c FROM w UNION ALL SELECT away_team, w, away_goals, home_goals FROM w),
mu AS (SELECT (sum(w * home_goals) + sum(w * away_goals)) / sum(w) / 2 AS mu FROM w)
SELECT team, round(sum(w), 6) AS weight, round(CASE WHEN sum(w) >= 5 THEN sum(w * s) / sum(w) / max(mu) ELSE 1 END, 6) AS attack,
 round(CASE WHEN sum(w) >= 5 THEN sum(w * c) / sum(w) / max(mu) ELSE 1 END, 6) AS defence FROM g, mu GROUP BY team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.poisson_strengths(inputs.matches(spark, sf), 365.0), ["team"], ["weight", "attack", "defence"])


_RATE = {
    "btts": "avg(CAST(home_goals > 0 AND away_goals > 0 AS INT))",
    "over": "avg(CAST(home_goals + away_goals > 2.5 AS INT))",
    "mean_total": "avg(home_goals + away_goals)",
}


@query("conditional_rates", "4.10", MW + f"SELECT result, {rsql(_RATE)} FROM matches GROUP BY result")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.conditional_rates(inputs.matches(spark, sf)), ["result"], list(_RATE))


@query(
    "goals_markets_from_1x2",
    "4.11 7.15",
    inputs.sql_with("matches", "preds")
    + f""", r AS (SELECT result, {', '.join(f'{e} AS {n}' for n, e in _RATE.items())} FROM matches GROUP BY result),
w AS (SELECT max(btts) FILTER (result = 'H') bh, max(btts) FILTER (result = 'D') bd, max(btts) FILTER (result = 'A') ba,
 max(over) FILTER (result = 'H') oh, max(over) FILTER (result = 'D') od, max(over) FILTER (result = 'A') oa FROM r)
SELECT match_id, model, round(p_h * bh + p_d * bd + p_a * ba, 6) AS p_btts,
 round(p_h * least(oh * 1.4, 0.95) + p_d * least(od * 1.4, 0.95) + p_a * least(oa * 1.4, 0.95), 6) AS p_over FROM preds, w""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rates = agg.rates_row(inputs.matches(spark, sf))
    out = agg.goals_markets_from_1x2(inputs.preds(spark, sf), rates, 3.5)
    return rounded(out, ["match_id", "model"], ["p_btts", "p_over"])


@query(
    "xg_from_shots",
    "4.12",
    MW
    + """, c AS (SELECT league, least((sum(home_goals) + sum(away_goals)) / (sum(home_sot) + sum(away_sot)), 0.5) AS c FROM matches GROUP BY league)
SELECT match_id, round(least(home_sot * c, 8), 6) AS home_xg_est, round(least(away_sot * c, 8), 6) AS away_xg_est FROM matches JOIN c USING (league)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.xg_from_shots(inputs.matches(spark, sf)), ["match_id"], ["home_xg_est", "away_xg_est"])


@query(
    "goal_overdispersion",
    "4.13",
    MW
    + """, p AS (SELECT league, home_sot AS sot, home_goals AS g FROM matches UNION ALL SELECT league, away_sot, away_goals FROM matches),
s AS (SELECT league, sot, avg(g) AS m, var_samp(g) AS v FROM p GROUP BY ALL)
SELECT league, round(greatest(median(v / nullif(m, 0)) FILTER (v IS NOT NULL), 0.8), 6) AS overdispersion FROM s GROUP BY league""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.overdispersion(inputs.matches(spark, sf)), ["league"], ["overdispersion"])


_POS_SQL = """CASE WHEN position IN ('GK', 'TW', 'T') OR position LIKE '%GOAL%' THEN 'GK'
 WHEN position IN ('DEF', 'CB', 'LB', 'RB', 'LWB', 'RWB', 'AB', 'IV', 'LV', 'RV') OR position LIKE '%DEF%' THEN 'DEF'
 WHEN position IN ('MID', 'CM', 'CDM', 'CAM', 'LM', 'RM', 'DM', 'MF', 'ZM', 'OM') OR position LIKE '%MID%' THEN 'MID'
 WHEN position IN ('FWD', 'ST', 'CF', 'LW', 'RW', 'SS', 'LF', 'RF', 'ANG', 'MS', 'HS') OR position LIKE '%FOR%' THEN 'FWD' ELSE 'MID' END"""
# Segments stand for positions; each gets a code of one of the four groups.
_SEGMENT_POSITION = {"BUILDING": "LB", "AUTOMOBILE": "Goalkeeper", "MACHINERY": "cam", "HOUSEHOLD": "Forward"}
_SEGMENT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENT_POSITION.items()) + " ELSE 'st' END"
_PL2 = PLW.replace("c_mktsegment AS position", f"{_SEGMENT_SQL} AS position")


def _players(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.players(spark, sf)
    return p.withColumn("position", F.expr(_SEGMENT_SQL.replace("c_mktsegment", "position")))


def _depth(g: str, n: int) -> str:
    return f"least(count(*) FILTER (g = '{g}' AND NOT away), {n}) / {n}e0"


def _part(cond: str) -> str:
    return f"10 * least(coalesce(sum(market_value) FILTER ({cond}), 0) / greatest(sum(v), 1) * 2, 1)"


def _rating(cond: str) -> str:
    return f"coalesce(4 + 3 * (avg(ln(1 + v)) FILTER ({cond})) / max(ln(1 + v)), 6)"


_SQUAD = {
    "rating_avg": (_rating("TRUE"), 2), "rating_gk": (_rating("g = 'GK'"), 2), "rating_def": (_rating("g = 'DEF'"), 2),
    "rating_mid": (_rating("g = 'MID'"), 2), "rating_fwd": (_rating("g = 'FWD'"), 2),
    "squad_depth_score": (f"10 * (0.25 * {_depth('GK', 3)} + 0.30 * {_depth('DEF', 8)} + 0.25 * {_depth('MID', 8)} + 0.20 * {_depth('FWD', 6)})", 2),
    "form_index": ("10 * (avg(CAST(NOT away AS INT)) * (1 - 0.3 * (sum(v) FILTER (rn <= 3)) / sum(v)))", 2),
    "key_player_impact": ("least(coalesce(sum(market_value) FILTER (away), 0) / greatest(sum(v), 1), 1)", 3),
    "experience_score": ("least(greatest(10 * (avg(age) - 18) / 20, 0), 10)", 2),
    "attack_strength": (_part("g = 'FWD'"), 2), "defence_strength": (_part("g IN ('DEF', 'GK')"), 2),
    "midfield_control": (_part("g = 'MID'"), 2),
    "set_piece_threat": (f"10 * (0.5 * least(coalesce(avg(age) FILTER (g = 'DEF'), 25) / 30, 1) + 0.5 * least({_rating(chr(103) + ' = ' + chr(39) + 'DEF' + chr(39))} / 10, 1))", 2),
    "pace_index": ("least(greatest(10 * (1 - (coalesce(avg(age) FILTER (g IN ('FWD', 'MID')), 25) - 18) / 20), 0), 10)", 2),
    "discipline_score": ("10 * least(avg(age) / 30, 1)", 2),
    "goals_per_fwd": ("coalesce(sum(goals) FILTER (g = 'FWD'), 0) / greatest(count(*) FILTER (g = 'FWD'), 1)", 2),
    "injury_rate": ("sum(injured) / count(*)", 3),
    "starter_quality": ("10 * least((sum(market_value) FILTER (rn <= 11)) / greatest(sum(v), 1) * 2, 1)", 2),
    "avg_age": ("avg(age)", 1), "total_value": ("sum(v)", 1),
}


@query(
    "squad_stats",
    "4.14 2.10",
    _PL2
    + f""", q AS (SELECT *, injured = 1 OR suspended = 1 AS away, CASE WHEN market_value = 0 THEN 0.1 ELSE market_value END AS v,
 {_POS_SQL.replace('position', 'upper(trim(position))')} AS g FROM players),
p AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY v DESC, player_id) AS rn FROM q)
SELECT team, count(*) AS squad_size, count(*) FILTER (away) AS n_unavailable, {', '.join(f'round(CAST({e} AS DOUBLE), {d}) AS {n}' for n, (e, d) in _SQUAD.items())}
FROM p GROUP BY team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return squad.squad_stats(_players(spark, sf))


@query(
    "squad_info",
    "4.15",
    PLW
    + """, p AS (SELECT *, CASE WHEN position = 'AUTOMOBILE' THEN 'GK' ELSE 'MID' END AS pos, CAST(player_id % 11 = 0 AS INT) AS is_starter, injured = 1 OR suspended = 1 AS away FROM players)
SELECT team, CAST(sum(injured) AS BIGINT) AS injured_count, CAST(sum(suspended) AS BIGINT) AS suspended_count, round(avg(age), 1) AS avg_age, round(sum(market_value), 1) AS squad_value,
 CASE WHEN count(*) FILTER (pos = 'GK' AND is_starter = 1) > 0 THEN count(*) FILTER (pos = 'GK' AND is_starter = 1 AND away) > 0
  ELSE count(*) FILTER (pos = 'GK') > 0 AND count(*) FILTER (pos = 'GK' AND NOT away) = 0 END AS missing_gk,
 arg_max(away, goals * 1000000000e0 - player_id) AS missing_top_scorer FROM p GROUP BY team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.players(spark, sf)
    p = p.withColumn("position", F.when(F.col("position") == "AUTOMOBILE", "GK").otherwise("MID")).withColumn(
        "is_starter", (F.col("player_id") % 11 == 0).cast("int")
    )
    return squad.squad_info(p)


@query(
    "form_scores",
    "4.16",
    TGW
    + """, r AS (SELECT team, points FROM team_games QUALIFY row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) <= 5)
SELECT team, count(*) AS games, round(CASE WHEN count(*) >= 3 THEN sum(points) / (3e0 * count(*)) * 2 - 1 ELSE 0 END, 6) AS form_score FROM r GROUP BY team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.form_scores(inputs.matches(spark, sf)), ["team", "games"], ["form_score"])


@query(
    "target_encoding",
    "4.17",
    MW
    + """, f AS (SELECT home_team, avg(CAST(result = 'H' AS INT)) AS te FROM matches WHERE season < 1999 AND league <> 'ASIA' GROUP BY home_team)
SELECT match_id, round(coalesce(te, 0.45), 6) AS home_team_te FROM matches LEFT JOIN f USING (home_team) WHERE season >= 1999""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    enc = agg.fit_target_encoding(m.filter("season < 1999 AND league <> 'ASIA'"), "home_team", (F.col("result") == "H").cast("int"))
    return rounded(agg.apply_target_encoding(m.filter("season >= 1999"), enc, "home_team", 0.45), ["match_id"], ["home_team_te"])


@query(
    "strength_bins",
    "4.18",
    MW
    + """SELECT CASE WHEN (home_xg + away_xg) / 2 >= 1.6 THEN 3 WHEN (home_xg + away_xg) / 2 >= 1.2 THEN 2 WHEN (home_xg + away_xg) / 2 >= 0.8 THEN 1 ELSE 0 END AS bin,
 count(*) AS n, round(avg(home_goals + away_goals), 6) AS avg_total, round(avg(CAST(home_goals + away_goals > 2.5 AS INT)), 6) AS over_rate FROM matches GROUP BY bin""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.strength_bins(inputs.matches(spark, sf), [0.8, 1.2, 1.6]), ["bin", "n"], ["avg_total", "over_rate"])


@query(
    "database_statistics",
    "4.23",
    TGW
    + """SELECT league, count(DISTINCT match_id) AS matches, count(DISTINCT team) AS teams, count(DISTINCT season) AS seasons,
 min(match_date) AS first_date, max(match_date) AS last_date FROM team_games GROUP BY league""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.database_statistics(inputs.matches(spark, sf))


@query(
    "outcome_shares",
    "4.24 10.42",
    MW + "SELECT result, count(*) AS n, round(count(*) / (SELECT count(*) FROM matches), 6) AS share FROM matches GROUP BY result",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.shares(inputs.matches(spark, sf), "result"), ["result", "n"], ["share"])


@query(
    "team_goal_totals",
    "4.25",
    TGW
    + "SELECT team, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(conceded) AS BIGINT) AS conceded, count(*) AS games FROM team_games GROUP BY team ORDER BY scored DESC, team LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.team_totals(inputs.matches(spark, sf), 10)


_CORR = ["home_goals", "away_goals", "home_xg", "away_xg", "home_shots", "away_shots"]


@query(
    "correlation_matrix",
    "4.26 4.37",
    MW
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM matches" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.correlation_pairs(inputs.matches(spark, sf), _CORR), ["a", "b"], ["r"])


@query(
    "goal_histogram",
    "4.29",
    MW
    + """, g AS (SELECT home_goals AS goals, 1 AS h, 0 AS a FROM matches UNION ALL SELECT away_goals, 0, 1 FROM matches)
SELECT goals, CAST(sum(h) AS BIGINT) AS home_n, CAST(sum(a) AS BIGINT) AS away_n FROM g GROUP BY goals""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.goal_histogram(inputs.matches(spark, sf))


_SIDE = {
    "win_rate": "avg(CAST(points = 3 AS INT))", "draw_rate": "avg(CAST(points = 1 AS INT))",
    "loss_rate": "avg(CAST(points = 0 AS INT))", "avg_scored": "avg(scored)",
}


@query("home_away_record", "4.30", TGW + f"SELECT is_home, {rsql(_SIDE)} FROM team_games GROUP BY is_home")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.side_record(inputs.matches(spark, sf)), ["is_home"], list(_SIDE))


_NULLS = {c: f"CASE WHEN {c} > 1.5 THEN {c} END" for c in ("home_xg", "away_xg", "odds_h")}


@query(
    "missing_pattern",
    "4.31 10.40",
    MW
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({e}) AS nulls, round((count(*) - count({e})) / count(*), 6) AS share FROM matches"
        for c, e in _NULLS.items()
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.matches(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in _NULLS.items()])
    return rounded(agg.null_counts(df), ["column", "nulls"], ["share"])


# Experiment runs: one run per (user, event type), its metrics are statistics of the events.
_RUNS_SQL = """WITH r AS (SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, round(avg(value), 4) AS val_accuracy, round(max(value) - min(value), 4) AS val_log_loss, round(stddev_samp(value), 4) AS rmse
 FROM events GROUP BY user_id),
m AS (SELECT run_id, 'val_accuracy' AS metric, val_accuracy AS value FROM r UNION ALL SELECT run_id, 'val_log_loss', val_log_loss FROM r UNION ALL SELECT run_id, 'rmse', rmse FROM r)
"""


def _run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    per = inputs.table(spark, sf, "events").groupBy(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id")).agg(
        F.round(F.avg("value"), 4).alias("val_accuracy"),
        F.round(F.max("value") - F.min("value"), 4).alias("val_log_loss"),
        F.round(F.stddev_samp("value"), 4).alias("rmse"),
    )
    return per.unpivot("run_id", ["val_accuracy", "val_log_loss", "rmse"], "metric", "value")


@query(
    "experiment_ranking",
    "4.27",
    _RUNS_SQL
    + "SELECT run_id, value, row_number() OVER (ORDER BY value, run_id) AS rank FROM m WHERE metric = 'val_log_loss' AND value IS NOT NULL ORDER BY value, run_id LIMIT 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.rank_runs(_run_metrics(spark, sf).filter("value IS NOT NULL"), "val_log_loss", 20).withColumn("rank", F.col("rank").cast("long"))


@query(
    "experiment_best_runs",
    "4.28 9.35",
    _RUNS_SQL
    + """SELECT metric, run_id, value FROM m WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric
 ORDER BY CASE WHEN metric = 'val_accuracy' THEN -value ELSE value END, run_id) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.best_runs(_run_metrics(spark, sf).filter("value IS NOT NULL"))


@query("experiment_table", "4.28", _RUNS_SQL + "SELECT run_id, val_accuracy, val_log_loss, rmse FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return agg.runs_wide(_run_metrics(spark, sf), ["val_accuracy", "val_log_loss", "rmse"])


@query(
    "task_success_rate",
    "4.34",
    "SELECT count(*) AS total, round(avg(CAST(event_type <> 'error' AS INT)), 6) AS success_rate FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tasks = inputs.table(spark, sf, "events").select("ts", (F.col("event_type") != "error").alias("ok"))
    return rounded(agg.success_rate(tasks, 7), ["total"], ["success_rate"])


@query(
    "xg_per_match",
    "4.33",
    TGW + "SELECT season, team, count(*) AS games, round(avg(xg), 6) AS xg_per_match, round(avg(xga), 6) AS xga_per_match FROM team_games GROUP BY season, team",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agg.xg_per_match(inputs.matches(spark, sf)), ["season", "team", "games"], ["xg_per_match", "xga_per_match"])


@query(
    "xg_scaled_by_team_rate",
    "4.32",
    TGW
    + """, f AS (SELECT team, (avg(scored) / 2 + 0.4) / avg(xg) AS f FROM team_games GROUP BY team)
SELECT match_id, team, is_home, round(xg * f, 6) AS xg_scaled FROM team_games JOIN f USING (team)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    rates = inputs.team_games(spark, sf).groupBy("team").agg((F.avg("scored") / 2 + 0.4).alias("xg_rate"))
    return rounded(agg.scale_xg_by_team_rate(m, rates), ["match_id", "team", "is_home"], ["xg_scaled"])
