"""The SQL query corpus: dashboard, history, value, performance and standings queries.

Each query is SQL text with `{table}` places. Spark runs it over DataFrames, the check over common
table expressions of the same content. Per-team lookups are answered for every team at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.operators.form import ORDER
from touchline.operators.windows import Expanding, Trailing, with_asof
from touchline.plans import inputs
from touchline.plans.registry import query
from touchline.sources.shared import new_path
from pyspark.sql import functions as F

_PAST = "OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_HISTORY_CTE = f"""history AS (SELECT match_id, match_date, season, league, team, is_home, xg, shots, sot,
 1500e0 + 8e0 * (coalesce(sum(points) {_PAST.format('UNBOUNDED')}, 0) - 1.4e0 * count(points) {_PAST.format('UNBOUNDED')}) AS elo_before,
 round(avg(points) {_PAST.format(5)}, 6) AS last_5_ppg, round(avg(scored) {_PAST.format(5)}, 6) AS last_5_scored,
 round(avg(conceded) {_PAST.format(5)}, 6) AS last_5_conceded, points FROM team_games)"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Rating, form and expected goals per team and match, as kept in the history tables."""
    out = with_asof(
        inputs.team_games(spark, sf),
        ["team"],
        ORDER,
        {
            "_p": Expanding(F.col("points"), "sum"),
            "_n": Expanding(F.col("points"), "count"),
            "ppg": Trailing(F.col("points"), 5),
            "gs": Trailing(F.col("scored"), 5),
            "gc": Trailing(F.col("conceded"), 5),
        },
    )
    return out.select(
        "match_id", "match_date", "season", "league", "team", "is_home", "xg", "shots", "sot",
        (1500.0 + 8.0 * (F.coalesce("_p", F.lit(0.0)) - 1.4 * F.col("_n"))).alias("elo_before"),
        F.round("ppg", 6).alias("last_5_ppg"), F.round("gs", 6).alias("last_5_scored"), F.round("gc", 6).alias("last_5_conceded"),
        "points",
    )


_SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "matches": inputs.matches,
    "team_games": inputs.team_games,
    "books": inputs.books,
    "preds": inputs.preds,
    "history": _history,
}


def corpus(name: str, covers: str, text: str) -> None:
    """Register one SQL text for both engines."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))
    derived = [t for t in used if t in _SOURCES and t != "history"]
    if "history" in used and "team_games" not in derived:
        derived.append("team_games")
    with_text = inputs.sql_with(*derived, more=_HISTORY_CTE if "history" in used else "") if derived else ""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        frames = {t: _SOURCES[t](spark, sf) if t in _SOURCES else inputs.table(spark, sf, t) for t in used}
        return spark.sql(text, **frames)

    query(name, covers, with_text + text.format(**{t: t for t in used}))(run)


corpus(
    "corpus_upcoming",
    "14.1 3.18",
    """SELECT m.match_id, m.match_date, m.home_team, m.away_team, hn.n_nationkey AS stadium_key, s.s_name AS referee
FROM {matches} m JOIN {nation} hn ON hn.n_name = m.home_team LEFT JOIN {supplier} s ON s.s_suppkey = m.referee_id
WHERE m.status = 'scheduled' ORDER BY m.match_date, m.match_id LIMIT 20""",
)
corpus(
    "corpus_team_recent_matches",
    "14.2 3.28",
    """SELECT * FROM (SELECT team, match_id, match_date, opponent, is_home, scored, conceded,
 CAST(row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS BIGINT) AS rn FROM {team_games}) r WHERE rn <= 10""",
)
corpus(
    "corpus_match_detail",
    "14.3",
    """SELECT m.match_id, m.home_team, m.away_team, m.home_goals, m.away_goals, m.attendance, b.bookmaker, b.quoted_on, s.s_name AS referee, b.odds_h
FROM {matches} m LEFT JOIN (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY quoted_on DESC, bookmaker) AS BIGINT) AS rn FROM {books}) q WHERE rn = 1) b
 ON b.match_id = m.match_id LEFT JOIN {supplier} s ON s.s_suppkey = m.referee_id""",
)
corpus(
    "corpus_season_matches",
    "14.4",
    """SELECT m.league, m.season, CAST(row_number() OVER (PARTITION BY m.league, m.season ORDER BY m.match_date, m.match_id) AS BIGINT) AS place, m.match_date,
 m.home_team, m.away_team, m.home_goals, m.away_goals, m.result FROM {matches} m JOIN {nation} n ON n.n_name = m.home_team WHERE m.status = 'finished'""",
)
corpus(
    "corpus_date_range",
    "14.5",
    """SELECT count(*) AS n, round(avg(home_goals), 6) AS avg_home, round(avg(away_goals), 6) AS avg_away FROM {matches}
WHERE match_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND result IS NOT NULL""",
)
corpus(
    "corpus_elo_history",
    "14.6",
    """SELECT * FROM (SELECT team, match_id, round(elo_before, 4) AS elo_before, CAST(row_number() OVER (PARTITION BY team ORDER BY match_id DESC) AS BIGINT) AS rn
 FROM {history} WHERE is_home = 1) h WHERE rn <= 50""",
)
corpus(
    "corpus_team_form",
    "14.7",
    """SELECT * FROM (SELECT team, match_id, last_5_ppg, last_5_scored, last_5_conceded, CAST(row_number() OVER (PARTITION BY team ORDER BY match_id DESC) AS BIGINT) AS rn
 FROM {history}) h WHERE rn <= 38""",
)
corpus(
    "corpus_xg_trend",
    "14.8",
    """SELECT * FROM (SELECT team, match_id, round(xg, 6) AS xg, shots, sot, CAST(row_number() OVER (PARTITION BY team ORDER BY match_id DESC) AS BIGINT) AS rn
 FROM {team_games}) h WHERE rn <= 38""",
)
corpus(
    "corpus_prediction_features",
    "14.9 3.16",
    """SELECT m.match_id, m.match_date, round(h.elo_before, 4) AS home_elo, round(a.elo_before, 4) AS away_elo, h.last_5_ppg AS home_form, a.last_5_ppg AS away_form,
 round(h.xg, 6) AS home_xg, round(a.xg, 6) AS away_xg FROM {matches} m JOIN {history} h ON h.match_id = m.match_id AND h.team = m.home_team
 JOIN {history} a ON a.match_id = m.match_id AND a.team = m.away_team""",
)
corpus(
    "corpus_head_to_head",
    "14.10 3.17",
    """SELECT * FROM (SELECT least(home_team, away_team) AS team_a, greatest(home_team, away_team) AS team_b, match_date, home_goals, away_goals, result,
 CAST(row_number() OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY match_date DESC, match_id DESC) AS BIGINT) AS rn
 FROM {matches} WHERE result IS NOT NULL) h WHERE rn <= 10""",
)
corpus(
    "corpus_value_upcoming",
    "14.11",
    """SELECT m.match_id, m.match_date, round(p.p_h, 6) AS p_h, b.odds_h, round(p.p_h * b.odds_h - 1, 4) AS ev FROM {matches} m
JOIN {preds} p ON p.match_id = m.match_id AND p.model = 'ensemble' JOIN {books} b ON b.match_id = m.match_id AND b.bookmaker = 'B1'
WHERE m.status = 'scheduled' AND p.p_h * b.odds_h - 1 > 0.05 ORDER BY p.p_h * b.odds_h DESC, m.match_id LIMIT 20""",
)
corpus(
    "corpus_model_performance",
    "14.12",
    """SELECT p.model, count(*) AS total, round(avg(CASE WHEN (CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END) = m.result THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
 round(avg(greatest(p_h, p_d, p_a)), 6) AS avg_conf FROM {preds} p JOIN {matches} m ON m.match_id = p.match_id WHERE m.result IS NOT NULL AND p.p_h IS NOT NULL GROUP BY p.model""",
)
corpus(
    "corpus_strategy_pnl",
    "14.13",
    """SELECT p.model AS strategy, count(*) AS total_bets, count(CASE WHEN m.result = 'H' THEN 1 END) AS wins,
 round(avg(CASE WHEN m.result = 'H' THEN m.odds_h - 1 ELSE -1e0 END) * 100, 4) AS avg_roi, round(sum(CASE WHEN m.result = 'H' THEN m.odds_h - 1 ELSE -1e0 END), 4) AS total_profit
FROM {preds} p JOIN {matches} m ON m.match_id = p.match_id WHERE p.p_h * m.odds_h > 1.05e0 GROUP BY p.model""",
)
corpus(
    "corpus_closing_line",
    "14.14",
    """SELECT bookmaker, outcome, count(*) AS n, round(avg((open - shut) / shut), 6) AS avg_clv, round(avg(open), 4) AS avg_open, round(avg(shut), 4) AS avg_close FROM (
 SELECT bookmaker, 'H' AS outcome, odds_h AS open, close_h AS shut FROM {books} UNION ALL SELECT bookmaker, 'D', odds_d, close_d FROM {books}
 UNION ALL SELECT bookmaker, 'A', odds_a, close_a FROM {books}) q GROUP BY bookmaker, outcome""",
)
corpus(
    "corpus_best_value_bets",
    "14.15",
    """SELECT match_id, bookmaker, round(p_h * odds_h - 1, 4) AS ev_home, round(p_d * odds_d - 1, 4) AS ev_draw, round(p_a * odds_a - 1, 4) AS ev_away FROM (
 SELECT b.*, p.p_h, p.p_d, p.p_a FROM {books} b JOIN {preds} p ON p.match_id = b.match_id AND p.model = 'goals') q
WHERE greatest(p_h * odds_h, p_d * odds_d, p_a * odds_a) - 1 > 0.10 ORDER BY greatest(p_h * odds_h, p_d * odds_d, p_a * odds_a) DESC, match_id, bookmaker LIMIT 50""",
)
corpus(
    "corpus_standings",
    "14.16 4.7",
    """SELECT league, season, team, CAST(sum(played) AS BIGINT) AS played, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(points) AS BIGINT) AS points FROM (
 SELECT league, season, home_team AS team, count(*) AS played, sum(CASE WHEN result = 'H' THEN 1 ELSE 0 END) AS wins, sum(home_goals) AS gf,
  sum(CASE result WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END) AS points FROM {matches} WHERE result IS NOT NULL GROUP BY league, season, home_team
 UNION ALL SELECT league, season, away_team, count(*), sum(CASE WHEN result = 'A' THEN 1 ELSE 0 END), sum(away_goals),
  sum(CASE result WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END) FROM {matches} WHERE result IS NOT NULL GROUP BY league, season, away_team) s GROUP BY league, season, team""",
)
corpus(
    "corpus_attendance",
    "14.17",
    """SELECT league, season, count(*) AS matches, round(avg(attendance), 0) AS avg_attendance, CAST(sum(home_goals + away_goals) AS BIGINT) AS total_goals
FROM {matches} WHERE attendance IS NOT NULL AND result IS NOT NULL GROUP BY league, season""",
)
corpus(
    "corpus_referee_bias",
    "14.18",
    """SELECT s.s_name AS referee, count(*) AS matches_officiated, round(avg(CASE WHEN m.result = 'H' THEN 1e0 ELSE 0e0 END), 6) AS home_win_rate,
 round(avg(CASE WHEN m.result = 'D' THEN 1e0 ELSE 0e0 END), 6) AS draw_rate FROM {matches} m JOIN {supplier} s ON s.s_suppkey = m.referee_id
WHERE m.result IS NOT NULL GROUP BY s.s_suppkey, s.s_name HAVING count(*) > 10""",
)
corpus(
    "corpus_player_performance",
    "14.19",
    """SELECT * FROM (SELECT c_custkey AS player_id, l_orderkey AS match_id, l_linenumber AS entry, l_quantity AS minutes_played, round(l_extendedprice, 2) AS rating,
 CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS rn
 FROM {customer} JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey) p WHERE rn <= 50""",
)
corpus(
    "corpus_team_dashboard",
    "3.16",
    """SELECT h.team, r.r_name AS competition, h.season, h.match_id, h.is_home, round(h.elo_before, 4) AS elo_before, h.last_5_ppg, round(h.xg, 6) AS xg, m.result
FROM {nation} n JOIN {history} h ON h.team = n.n_name JOIN {matches} m ON m.match_id = h.match_id JOIN {region} r ON r.r_name = m.league""",
)


@query(
    "corpus_append_predictions",
    "14.20",
    inputs.sql_with("matches")
    + """SELECT match_id, 'test_model' AS model_name, 'v1' AS model_version, 0.45e0 AS prob_home, 0.3e0 AS prob_draw, 0.25e0 AS prob_away,
 CASE WHEN match_id * 7919 % 1000 < 450 THEN 'H' WHEN match_id * 7919 % 1000 < 750 THEN 'D' ELSE 'A' END AS predicted_result FROM matches WHERE result IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of all decided matches appended to a table, home wins first, then the others."""
    draw = F.col("match_id") * 7919 % 1000
    rows = inputs.matches(spark, sf).filter("result IS NOT NULL").select(
        "match_id", F.lit("test_model").alias("model_name"), F.lit("v1").alias("model_version"),
        F.lit(0.45).alias("prob_home"), F.lit(0.3).alias("prob_draw"), F.lit(0.25).alias("prob_away"),
        F.when(draw < 450, "H").when(draw < 750, "D").otherwise("A").alias("predicted_result"),
    )
    path = new_path(spark, "predictions")
    for decided in ("predicted_result = 'H'", "predicted_result <> 'H'"):
        rows.filter(decided).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
