"""Quality checks, profiles, drift, monitoring, versions, feature values and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import profile, quality, versions
from touchline.plans import inputs
from touchline.plans.common import rounded, rsql
from touchline.plans.registry import query
from touchline.sources.shared import new_path, written

MW = inputs.sql_with("matches")

# Matches as a careless source would deliver them: every column as text, with planted faults.
_DIRTY = {
    "match_id": "match_id",
    "match_date": "CASE WHEN match_id % 17 = 0 THEN NULL WHEN match_id % 19 = 0 THEN 'soon' WHEN match_id % 23 = 0 THEN '2190-01-01' ELSE CAST(match_date AS {s}) END",
    "home_team": "CASE WHEN match_id % 29 = 0 THEN ' ' ELSE home_team END",
    "away_team": "CASE WHEN match_id % 31 = 0 THEN home_team ELSE away_team END",
    "home_goals": "CASE WHEN match_id % 13 = 0 THEN '-1' WHEN match_id % 37 = 0 THEN '25' WHEN match_id % 41 = 0 THEN 'x' WHEN match_id % 11 = 0 THEN NULL ELSE CAST(home_goals AS {s}) END",
    "away_goals": "CAST(away_goals AS {s})",
    "result": "CASE WHEN match_id % 43 = 0 THEN 'H' ELSE result END",
    "odds_h": "CASE WHEN match_id % 47 = 0 THEN '0.9' WHEN match_id % 53 = 0 THEN 'n/a' ELSE CAST(odds_h AS {s}) END",
    "league": "CASE WHEN match_id % 59 = 0 THEN NULL WHEN match_id % 61 = 0 THEN 'MARS' ELSE league END",
    "status": "status",
    "home_shots": "CASE WHEN match_id % 67 = 0 THEN '-3' ELSE CAST(home_shots AS {s}) END",
}
_DW = MW + ", d AS (SELECT " + ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in _DIRTY.items()) + " FROM matches)\n"
_LEAGUES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_TODAY = "2024-01-01"


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.matches(spark, sf).selectExpr(*[f"{e.format(s='STRING')} AS {n}" for n, e in _DIRTY.items()])


_BLANK = "({c} IS NULL OR trim({c}) = '')"
_ROWS: dict[str, tuple[str, str, str]] = {
    "check_invalid_dates": (
        "10.2",
        f"SELECT match_id AS row_id, 'match_date' AS field FROM d WHERE match_date IS NULL OR match_date IN ('soon', '2190-01-01')",
        "check_invalid_dates",
    ),
    "check_invalid_odds": ("10.3", "SELECT match_id AS row_id, 'odds_h' AS field FROM d WHERE odds_h IN ('0.9', 'n/a')", "check_invalid_odds"),
    "check_missing_goals": ("10.4", "SELECT match_id AS row_id, 'home_goals' AS field FROM d WHERE home_goals IS NULL", "check_missing_goals"),
    "check_missing_teams": (
        "10.5",
        f"SELECT match_id AS row_id, 'home_team' AS field FROM d WHERE trim(home_team) = '' UNION ALL SELECT match_id, 'away_team' FROM d WHERE home_team = away_team",
        "check_missing_teams",
    ),
    "check_incorrect_leagues": ("10.6", "SELECT match_id AS row_id, 'league' AS field FROM d WHERE league IS NULL OR league = 'MARS'", "check_incorrect_leagues"),
    "check_invalid_statistics": ("10.7", "SELECT match_id AS row_id, 'home_shots' AS field FROM d WHERE home_shots = '-3'", "check_invalid_statistics"),
    "check_impossible_scores": (
        "10.9",
        """SELECT match_id AS row_id, 'home_goals' AS field FROM d WHERE home_goals IN ('-1', '25', 'x') UNION ALL SELECT match_id, 'result' FROM (SELECT *, try_cast(home_goals AS INT) AS h, CAST(away_goals AS INT) AS a FROM d) q
 WHERE h IS NOT NULL AND result <> CASE WHEN h > a THEN 'H' WHEN a > h THEN 'A' ELSE 'D' END""",
        "check_impossible_scores",
    ),
}


def _register_checks() -> None:
    extra = {"check_invalid_dates": {"today": _TODAY}, "check_incorrect_leagues": {"allowed": _LEAGUES}}

    def make(fn: str):  # noqa: ANN202
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return getattr(quality, fn)(_dirty(spark, sf), "match_id", **extra.get(fn, {})).select("row_id", "field")

        return run

    for name, (ids, sql, fn) in _ROWS.items():
        query(name, ids, _DW + sql)(make(fn))


_register_checks()


@query(
    "check_duplicate_matches",
    "10.1",
    MW + "SELECT match_id AS row_id FROM matches QUALIFY row_number() OVER (PARTITION BY lower(home_team), lower(away_team), match_date ORDER BY match_id) > 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_duplicate_matches(inputs.matches(spark, sf), "match_id").select("row_id")


@query(
    "check_duplicate_ids",
    "10.8",
    "SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_duplicate_ids(inputs.table(spark, sf, "events"), "event_id", "user_id").select("row_id", "value")


@query(
    "check_summary",
    "10.1 10.2 10.3 10.4 10.5 10.6 10.7 10.9",
    _DW
    + ", v AS ("
    + " UNION ALL ".join(f"SELECT '{n.removeprefix('check_')}' AS \"check\", row_id, field FROM ({s}) q" for n, (_, s, _f) in _ROWS.items())
    + """ UNION ALL SELECT 'duplicate_matches', match_id, 'match' FROM d QUALIFY row_number() OVER (PARTITION BY lower(home_team), lower(away_team), coalesce(match_date, '') ORDER BY match_id) > 1)
SELECT "check", field, count(*) AS violations, count(DISTINCT row_id) AS rows FROM v GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summarise(quality.all_row_checks(_dirty(spark, sf), "match_id", _TODAY, _LEAGUES))


# ---------------------------------------------------------------- feature checks: numbers with planted gaps

_FEAT = {
    "match_id": "match_id", "f_const": "1.5e0", "f_sparse": "CASE WHEN match_id % 3 = 0 THEN home_xg END", "f_nan": "CASE WHEN match_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE away_xg END",
    "f_inf": "CASE WHEN match_id % 70 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE odds_h END", "f_low": "CAST(home_goals AS DOUBLE) / 1000e0", "f_copy": "odds_d", "f_copy2": "odds_d", "prob_h": "1.2e0 / odds_h",
}
_FW = MW + ", f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FEAT.items()) + " FROM matches)\n"
_FC = [c for c in _FEAT if c != "match_id"]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.matches(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in _FEAT.items()])


@query(
    "feature_checks",
    "10.11 10.13 10.15 10.16 10.18",
    _FW
    + """SELECT feature, "check" FROM (SELECT 'f_const' AS feature, 'constant_features' AS "check" UNION ALL SELECT 'f_const', 'low_variance' UNION ALL SELECT 'f_sparse', 'missing_values' UNION ALL SELECT 'f_nan', 'nan_values'
 UNION ALL SELECT 'f_inf', 'infinite_values' UNION ALL SELECT 'f_low', 'low_variance') q WHERE (SELECT count(*) FROM f WHERE isnan(f_nan)) > 0 AND (SELECT var_samp(f_low) FROM f) < 0.001""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_features(_features(spark, sf), _FC)


@query(
    "feature_statistics",
    "10.11 10.13 10.18",
    _FW
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS nulls, count(*) FILTER (isnan({c})) AS nans, count(*) FILTER (isinf({c})) AS infinite, {rsql({'lowest': f'min({c}) FILTER (isfinite({c}))', 'highest': f'max({c}) FILTER (isfinite({c}))', 'mean': f'avg({c}) FILTER (isfinite({c}))', 'variance': f'var_samp({c}) FILTER (isfinite({c}))'})} FROM f"
        for c in _FC
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.feature_statistics(_features(spark, sf), _FC)
    return rounded(out, ["feature", "n", "nulls", "nans", "infinite"], ["lowest", "highest", "mean", "variance"])


@query("feature_ranges", "10.14", _FW + "SELECT 'prob_h' AS feature, count(*) FILTER (prob_h < 0.3) AS below, count(*) FILTER (prob_h > 0.9) AS above FROM f")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_ranges(_features(spark, sf), {"prob_*": (0.3, 0.9)})


@query("feature_duplicates", "10.17", _FW + "SELECT 'f_copy' AS a, 'f_copy2' AS b FROM f HAVING bool_and(f_copy IS NOT DISTINCT FROM f_copy2)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_duplicate_features(_features(spark, sf), _FC)


@query(
    "feature_correlated",
    "10.12",
    MW + "SELECT a, b, round(r, 6) AS r FROM (SELECT 'home_goals' AS a, 'home_sot' AS b, corr(home_goals, home_sot) AS r FROM matches UNION ALL SELECT 'home_goals', 'home_shots', corr(home_goals, home_shots) FROM matches UNION ALL SELECT 'home_sot', 'home_shots', corr(home_sot, home_shots) FROM matches) q WHERE abs(r) > 0.5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.aggregates import correlation_pairs
    from touchline.operators.learning import redundant_pairs

    pairs = correlation_pairs(inputs.matches(spark, sf), ["home_goals", "home_sot", "home_shots"])
    return rounded(redundant_pairs(pairs, 0.5), ["a", "b"], ["r"])


@query(
    "feature_time_order",
    "10.10",
    MW
    + """, o AS (SELECT league, match_date, lag(match_date) OVER (PARTITION BY league ORDER BY match_id) AS p FROM matches)
SELECT league, count(*) FILTER (match_date < p) AS out_of_order, count(*) FILTER (match_date = p) AS same_day FROM o GROUP BY league""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_time_order(inputs.matches(spark, sf), "match_date", "match_id", "league")


@query(
    "schema_validation",
    "10.37 10.46",
    _DW
    + """SELECT 'home_goals' AS "column", TRUE AS present, count(*) FILTER (home_goals IS NOT NULL AND try_cast(home_goals AS INT) IS NULL) AS bad_type, 0::BIGINT AS bad_null FROM d UNION ALL SELECT 'odds_h', TRUE, count(*) FILTER (odds_h IS NOT NULL AND try_cast(odds_h AS DOUBLE) IS NULL), 0 FROM d
 UNION ALL SELECT 'league', TRUE, 0, count(*) FILTER (league IS NULL) FROM d UNION ALL SELECT 'referee', FALSE, 0, count(*) FROM d""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"home_goals": ("int", True), "odds_h": ("double", True), "league": ("string", False), "referee": ("string", False)}
    return quality.validate_schema(_dirty(spark, sf), schema)


@query(
    "quality_rules",
    "10.55 10.56 10.57 4.36",
    _DW
    + """, r AS (SELECT 'not_empty' AS rule, (SELECT count(*) FROM d) > 0 AS passed UNION ALL SELECT 'no_nulls', (SELECT count(*) FROM d WHERE league IS NULL) = 0 UNION ALL SELECT 'no_nulls', (SELECT count(*) FROM d WHERE status IS NULL) = 0
 UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY match_id HAVING count(*) > 1) q) = 0 UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY league HAVING count(*) > 1) q) = 0)
SELECT rule, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY rule""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = _dirty(spark, sf)
    rows = quality.rule_not_empty(d).select(F.lit("not_empty").alias("rule"), "passed")
    rows = rows.unionByName(quality.rule_no_nulls(d, ["league", "status"]).select(F.lit("no_nulls").alias("rule"), "passed"))
    for keys in (["match_id"], ["league"]):
        rows = rows.unionByName(quality.rule_unique(d, keys).select(F.lit("unique").alias("rule"), "passed"))
    return quality.batch_summary(rows)


@query(
    "record_validation",
    "10.38 10.58",
    _DW
    + """, n AS (SELECT *, try_cast(home_goals AS DOUBLE) AS h, try_cast(away_goals AS DOUBLE) AS a, try_cast(odds_h AS DOUBLE) AS o FROM d),
f AS (SELECT coalesce(league, 'unknown') AS league, trim(home_team) = '' OR match_date IS NULL OR match_date = 'soon' OR coalesce(h < 0, FALSE) AS fatal,
 CAST(coalesce(match_date = '2190-01-01', FALSE) AS INT) + CAST(coalesce(o < 1, FALSE) AS INT) + CAST(coalesce(o > 100, FALSE) AS INT) + CAST(coalesce((result = 'H' AND h <= a) OR (result = 'A' AND a <= h) OR (result = 'D' AND h <> a), FALSE) AS INT) AS w FROM n)
SELECT league, count(*) AS total, count(*) FILTER (fatal) AS fatal, count(*) FILTER (NOT fatal) AS passed, CAST(sum(w) AS BIGINT) AS warnings FROM f GROUP BY league""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validate_records(_dirty(spark, sf), _TODAY)


@query(
    "clean_validation",
    "10.39",
    MW
    + """SELECT count(*) AS rows, 0::BIGINT AS missing_keys, 0::BIGINT AS bad_target, 0::BIGINT AS bad_goal_diff, min(match_date) AS first_date, max(match_date) AS last_date,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT match_date, home_team, away_team FROM matches) q) AS duplicates FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.clean import outcome_columns

    return quality.validate_clean(outcome_columns(inputs.matches(spark, sf)))


# ---------------------------------------------------------------- profile

_PCOLS = ["match_id", "league", "home_goals", "odds_h", "match_date"]


@query(
    "profile_columns",
    "10.25 10.41",
    MW
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS lowest, CAST(max({c}) AS VARCHAR) AS highest FROM matches" for c in _PCOLS if c != "odds_h"
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).select(*[c for c in _PCOLS if c != "odds_h"])
    return profile.column_summary(m).select("column", "nulls", "distinct", "lowest", "highest")


@query(
    "profile_missing",
    "10.40 10.53",
    _DW + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS share FROM d" for c in _DIRTY) + ") q ORDER BY nulls DESC, \"column\" LIMIT 5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.top_missing(_dirty(spark, sf), 5), ["column", "nulls"], ["share"])


_DUPW = "WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events)\n"


@query(
    "profile_duplicates",
    "10.29",
    _DUPW + "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / sum(n) * 100, 6) AS pct FROM (SELECT count(*) AS n FROM e GROUP BY user_id, event_type, day) q",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return rounded(profile.duplicate_summary(e), ["rows", "duplicates"], ["pct"])


@query(
    "profile_goals",
    "10.26",
    MW
    + " UNION ALL ".join(
        f"SELECT '{n}' AS side, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std, min({e}) AS lowest, max({e}) AS highest, median({e}) AS median FROM matches"
        for n, e in (("home", "home_goals"), ("away", "away_goals"), ("total", "home_goals + away_goals"))
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.goal_moments(inputs.matches(spark, sf)), ["side", "lowest", "highest", "median"], ["mean", "std"])


@query(
    "profile_odds",
    "10.27",
    MW
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS lowest, round(max({c}), 6) AS highest, round(median({c}), 6) AS median, count({c}) AS n_valid, count(*) - count({c}) AS n_null FROM matches"
        for c in ("odds_h", "odds_a")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.odds_summary(inputs.matches(spark, sf), ["odds_h", "odds_a"])
    return rounded(out, ["column", "n_valid", "n_null"], ["mean", "std", "lowest", "highest", "median"])


@query(
    "profile_odds_histogram",
    "10.27",
    MW + "SELECT CAST(least(floor((least(greatest(odds_h, 1), 20) - 1) / (19e0 / 20)), 19) AS INT) AS bin, count(*) AS n FROM matches GROUP BY bin",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(inputs.matches(spark, sf), "odds_h", 1.0, 20.0)


@query(
    "profile_categories",
    "10.43",
    MW + "SELECT home_team, count(*) AS n, round(count(*) / (SELECT count(*) FROM matches), 6) AS share FROM matches GROUP BY home_team ORDER BY n DESC, home_team LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.top_values(inputs.matches(spark, sf), "home_team"), ["home_team", "n"], ["share"])


@query(
    "profile_teams",
    "10.44",
    inputs.sql_with("team_games") + "SELECT team, count(*) AS matches, count(*) FILTER (is_home = 1) AS home, count(*) FILTER (is_home = 0) AS away FROM team_games GROUP BY team",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.team_appearances(inputs.matches(spark, sf))


@query(
    "profile_home_advantage",
    "10.45",
    MW + "SELECT round(avg(CAST(result = 'H' AS INT)) * 100, 6) AS home_win_pct, round(avg(CAST(result = 'A' AS INT)) * 100, 6) AS away_win_pct, round((avg(CAST(result = 'H' AS INT)) - avg(CAST(result = 'A' AS INT))) * 100, 6) AS advantage FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.home_advantage(inputs.matches(spark, sf)), [], ["home_win_pct", "away_win_pct", "advantage"])


@query(
    "profile_outliers",
    "10.28",
    """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT 'value' AS "column", count(*) AS n_outliers, round(min(value), 6) AS lowest, round(max(value), 6) AS highest FROM events, s WHERE abs((value - m) / s) > 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.outliers(inputs.table(spark, sf, "events"), ["value", "event_id"]), ["column", "n_outliers"], ["lowest", "highest"])


@query(
    "profile_coverage",
    "10.30",
    _DW + "SELECT status, count(*) AS rows, round(avg(CAST(odds_h IS NOT NULL AS INT)), 6) AS odds_coverage, round(avg(CAST(home_goals IS NOT NULL OR league IS NOT NULL AS INT)), 6) AS core_coverage, 0e0 AS xg_coverage FROM d GROUP BY status",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"odds": ["odds_h", "odds_x"], "core": ["home_goals", "league"], "xg": ["home_xg"]}
    out = profile.coverage(_dirty(spark, sf), groups, "status")
    return rounded(out, ["status", "rows"], ["odds_coverage", "core_coverage", "xg_coverage"])


@query(
    "profile_castable",
    "10.46",
    _DW + "SELECT 'home_goals' AS \"column\", TRUE AS present, round(avg(CASE WHEN home_goals IS NOT NULL THEN CAST(try_cast(home_goals AS INT) IS NOT NULL AS INT) END), 6) AS castable FROM d UNION ALL SELECT 'referee', FALSE, NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.castable(_dirty(spark, sf), {"home_goals": "int", "referee": "string"}), ["column", "present"], ["castable"])


@query(
    "quality_metrics",
    "10.31",
    _DUPW
    + "SELECT (SELECT count(*) FROM e) AS rows, 0.0::DOUBLE AS null_pct, round((SELECT sum(n - 1) / sum(n) * 100 FROM (SELECT count(*) AS n FROM e GROUP BY user_id, event_type, day) q), 6) AS duplicate_pct",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return rounded(profile.quality_metrics(e), ["rows"], ["null_pct", "duplicate_pct"])


# ---------------------------------------------------------------- drift: older seasons against newer ones

_DRIFT = ["home_xg", "odds_h", "home_shots"]


def _old_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = inputs.matches(spark, sf)
    return m.filter("season >= 1999"), m.filter("season < 1999")


_LONG = ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, CAST(season < 1999 AS INT) AS r FROM matches" for c in _DRIFT) + ")\n"


@query(
    "drift_equal_width",
    "10.19 10.20 10.54",
    MW
    + _LONG
    + """, s AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) FILTER (r = 0) AS nc, count(*) FILTER (r = 1) AS nr FROM v GROUP BY feature),
b AS (SELECT v.feature, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) FILTER (r = 0) / max(nc) + 1e-6 AS c, count(*) FILTER (r = 1) / max(nr) + 1e-6 AS r FROM v JOIN s USING (feature) GROUP BY 1, 2)
SELECT feature, round(sum((c - r) * ln(c / r)), 6) AS psi FROM b GROUP BY feature""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cur, ref = _old_new(spark, sf)
    return rounded(profile.drift_with_moments(cur, ref, _DRIFT), ["feature"], ["psi"])


_QPSI = (
    _LONG
    + """, q AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (r = 1) AS e FROM v GROUP BY feature),
n AS (SELECT feature, count(*) FILTER (r = 0) AS nc, count(*) FILTER (r = 1) AS nr FROM v GROUP BY feature),
g AS (SELECT feature, bin, e, nc, nr FROM q JOIN n USING (feature), (SELECT unnest(range(0, 10)) AS bin) b),
c AS (SELECT v.feature, len(list_filter(e, lambda x: x <= v.v)) AS bin, count(*) FILTER (r = 0) AS c, count(*) FILTER (r = 1) AS r FROM v JOIN q USING (feature) GROUP BY 1, 2),
p AS (SELECT g.feature, greatest(coalesce(c, 0) / nc, 1e-6) AS c, greatest(coalesce(r, 0) / nr, 1e-6) AS r FROM g LEFT JOIN c ON c.feature = g.feature AND c.bin = g.bin),
o AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM p GROUP BY feature)
"""
)


@query("drift_quantiles", "10.21", MW + _QPSI + "SELECT feature, round(psi, 6) AS psi FROM o")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cur, ref = _old_new(spark, sf)
    return rounded(profile.psi_quantiles(cur, ref, _DRIFT), ["feature"], ["psi"])


_CPSI = """, k AS (SELECT league AS v, count(*) FILTER (season >= 1999) AS c, count(*) FILTER (season < 1999) AS r FROM matches GROUP BY league),
kk AS (SELECT (c + 1e-6) / (sum(c) OVER () + 1e-6 * count(*) OVER ()) AS c, (r + 1e-6) / (sum(r) OVER () + 1e-6 * count(*) OVER ()) AS r FROM k)
"""


@query("drift_categories", "10.22", MW + _CPSI + "SELECT 'league' AS feature, round(sum((c - r) * ln(c / r)), 9) AS psi FROM kk")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.psi_categories(*_old_new(spark, sf), "league"), ["feature"], ["psi"], 9)


@query(
    "drift_report",
    "10.23",
    MW
    + _QPSI
    + _CPSI
    + """, u AS (SELECT feature, psi FROM o UNION ALL SELECT 'league', sum((c - r) * ln(c / r)) FROM kk) SELECT feature, round(psi, 6) AS psi, psi > 0.01 AS drifted, round((SELECT avg(psi) FROM u), 6) AS overall FROM u""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.drift_report(*_old_new(spark, sf), _DRIFT, ["league"], 0.01)
    return rounded(out, ["feature", "drifted"], ["psi", "overall"])


@query(
    "profile_drift",
    "10.24 10.47 10.48 10.49 10.50 10.51 10.52",
    _DW
    + """, p AS (SELECT count(*) AS n, avg(CAST(result = 'H' AS INT)) * 100 AS h FROM matches), c AS (SELECT count(*) AS n, avg(CAST(result = 'H' AS INT)) * 100 AS h, avg(CAST(home_goals IS NULL AS INT)) * 100 AS g FROM d WHERE status <> 'playing')
SELECT 'rows' AS metric, CAST(p.n AS DOUBLE) AS previous, CAST(c.n AS DOUBLE) AS current, CASE WHEN abs((c.n - p.n) / p.n) < 0.1 THEN 'info' WHEN abs((c.n - p.n) / p.n) < 0.3 THEN 'warning' ELSE 'critical' END AS severity FROM p, c
UNION ALL SELECT 'null_home_goals', 0, round(g, 4), CASE WHEN g < 10 THEN 'warning' ELSE 'critical' END FROM c WHERE g > 5 UNION ALL SELECT 'null_match_date', 0, round(v, 4), CASE WHEN v < 10 THEN 'warning' ELSE 'critical' END FROM (SELECT avg(CAST(match_date IS NULL AS INT)) * 100 AS v FROM d WHERE status <> 'playing') q WHERE v > 5
UNION ALL SELECT 'null_status', 0, NULL, 'critical'
UNION ALL SELECT 'columns', 11, 10, 'info'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cols = list(_DIRTY)
    previous = profile.profile_row(inputs.matches(spark, sf).select(*cols))
    current = profile.profile_row(_dirty(spark, sf).filter("status <> 'playing'").drop("status"))
    out = profile.profile_drift(current, previous)
    return rounded(out, ["metric", "severity"], ["previous", "current"], 4)


# ---------------------------------------------------------------- monitoring: events are metric records

_MET = "WITH m AS (SELECT event_type AS metric, ts, value FROM events)\n"


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "events").select(F.col("event_type").alias("metric"), "ts", "value")


@query("metric_history", "10.32 10.34", _MET + "SELECT metric, count(*) AS n, round(sum(value), 4) AS total FROM m WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 10 DAY GROUP BY metric")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.retain(_metrics(spark, sf), 10).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "metric_trend",
    "10.33",
    _MET
    + """, t AS (SELECT metric, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM m GROUP BY metric)
SELECT metric, f AS first, l AS last, round((l - f) / f * 100, 6) AS change_pct, CASE WHEN abs((l - f) / f * 100) < 5 THEN 'stable' WHEN l > f THEN 'up' ELSE 'down' END AS direction FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.metric_trend(_metrics(spark, sf)), ["metric", "first", "last", "direction"], ["change_pct"])


_RULES = [("slow", "view", ">", 100.0, "warning", 7200.0), ("low", "purchase", "<=", 5.0, "critical", 86400.0), ("odd", "error", ">=", 200.0, "info", 3600.0)]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "rule string, metric string, condition string, threshold double, severity string, cooldown double")


@query(
    "alert_breaches",
    "10.35",
    _MET
    + """SELECT rule, count(*) AS n, round(sum(value), 4) AS total FROM m JOIN (VALUES ('slow', 'view', 100e0, 1), ('low', 'purchase', 5e0, 2), ('odd', 'error', 200e0, 3)) r(rule, metric, t, k) USING (metric)
WHERE (k = 1 AND value > t) OR (k = 2 AND value <= t) OR (k = 3 AND value >= t) GROUP BY rule""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.breaches(_metrics(spark, sf), _rules(spark)).groupBy("rule").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("alerts_with_cooldown", "10.35")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.alerts(_metrics(spark, sf), _rules(spark)).select("rule", "ts", "value", "severity")


@query(
    "health_score",
    "10.36",
    """WITH r AS (SELECT count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'error' AND value > 150 AND ts >= TIMESTAMP '2024-01-25') AS recent FROM events),
s AS (SELECT ok / (ok + bad) AS rate, recent FROM r) SELECT round(rate, 6) AS success_rate, round(least(greatest((0.4 * rate + 0.6) * (0.2 * (1 - least(recent * 0.05, 1)) + 0.8) * (0.2 * 0.7 + 0.8) - 0.1, 0), 1), 6) AS health_score FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events")
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    # The newest report is a day and a half older than `now`, and only large errors count as recent.
    reports = e.select(
        F.least("ts", at).alias("ts"), (F.col("event_type") != "error").cast("int").alias("succeeded"), (F.col("event_type") == "error").cast("int").alias("failed"), "value"
    )
    week = F.lit("2024-01-25").cast("timestamp_ntz")
    small = (F.col("failed") == 1) & (F.col("value") <= 150) & (F.col("ts") >= week)
    reports = reports.withColumn("ts", F.when(small, F.lit("2024-01-02").cast("timestamp_ntz")).otherwise(F.col("ts")))
    newest = spark.range(1).select(F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("succeeded"), F.lit(0).alias("failed"))
    capped = reports.drop("value").withColumn("ts", F.least("ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))).unionByName(newest)
    system = e.select("ts", F.lit(95.0).alias("cpu"), F.lit(10.0).alias("memory"), F.lit(20.0).alias("disk"))
    return rounded(profile.health_score(capped, system, "2024-02-01 00:00:00"), [], ["success_rate", "health_score"])


@query(
    "processing_speed",
    "10.59",
    "SELECT o_orderpriority AS job, CAST(count(*) AS BIGINT) AS rows, round(count(*) / (sum(o_totalprice) / 1000000), 6) AS rows_per_second FROM orders GROUP BY o_orderpriority",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    runs = inputs.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(F.count("*").alias("rows"), (F.sum("o_totalprice") / 1000000).alias("seconds"))
    return rounded(profile.processing_speed(runs), ["job", "rows"], ["rows_per_second"])


# ---------------------------------------------------------------- versions: two states of the match table

_V = """, o AS (SELECT match_id, league, home_goals, away_goals FROM matches WHERE status <> 'playing'),
n AS (SELECT match_id, CASE WHEN season = 1997 THEN 'X' ELSE league END AS league, CASE WHEN season = 1998 THEN home_goals + 1 ELSE home_goals END AS home_goals, away_goals FROM matches WHERE status <> 'scheduled')
"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = inputs.matches(spark, sf)
    old = m.filter("status <> 'playing'").select("match_id", "league", "home_goals", "away_goals")
    new = m.filter("status <> 'scheduled'").selectExpr(
        "match_id", "CASE WHEN season = 1997 THEN 'X' ELSE league END AS league", "CASE WHEN season = 1998 THEN home_goals + 1 ELSE home_goals END AS home_goals", "away_goals"
    )
    return old, new


_DELTA = """, j AS (SELECT coalesce(n.match_id, o.match_id) AS match_id, CASE WHEN o.match_id IS NULL THEN 'inserted' WHEN n.match_id IS NULL THEN 'deleted' WHEN n.league <> o.league OR n.home_goals <> o.home_goals THEN 'updated' END AS change_type,
 coalesce(n.league, o.league) AS league, n.league <> o.league AS l, n.home_goals <> o.home_goals AS h FROM o FULL JOIN n ON n.match_id = o.match_id)
"""


@query("version_delta", "11.1 2.36", MW + _V + _DELTA + "SELECT match_id, league, change_type, sha256(CAST(match_id AS VARCHAR) || '|') AS fingerprint FROM j WHERE change_type IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return versions.compute_delta(*_states(spark, sf), ["match_id"]).select("match_id", "league", "change_type", "fingerprint")


@query(
    "version_changed_columns",
    "11.2",
    MW + _V + _DELTA + "SELECT * FROM (SELECT 'league' AS \"column\", count(*) AS rows FROM j WHERE change_type = 'updated' AND l UNION ALL SELECT 'home_goals', count(*) FROM j WHERE change_type = 'updated' AND h) q WHERE rows > 0",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return versions.changed_columns(versions.compute_delta(*_states(spark, sf), ["match_id"]))


@query(
    "version_compare",
    "11.3",
    MW + _V + _DELTA + "SELECT count(*) FILTER (change_type = 'inserted') AS n_inserted, count(*) FILTER (change_type = 'updated') AS n_updated, count(*) FILTER (change_type = 'deleted') AS n_deleted, count(*) FILTER (change_type IS NULL) AS n_unchanged FROM j",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return versions.compare_versions(*_states(spark, sf), ["match_id"])


@query(
    "version_store",
    "11.4 11.13 11.14 11.15",
    MW + _V + "SELECT 'v001' AS version, (SELECT count(*) FROM o) AS n_rows, TRUE AS intact, TRUE AS current UNION ALL SELECT 'v002', (SELECT count(*) FROM n), TRUE, FALSE",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _states(spark, sf)
    store = versions.VersionStore(spark, new_path(spark, "versions"))
    first, second = store.create(old), store.create(new)
    store.rollback(first)
    current = store.load().count()
    rows = [(v, store.load(v).count(), store.verify(v), store.load(v).count() == current) for v in (first, second)]
    return spark.createDataFrame(rows, "version string, n_rows long, intact boolean, current boolean")


# ---------------------------------------------------------------- feature values: events as computed values of users

_ENT = "WITH u AS (SELECT DISTINCT c_custkey AS entity_id FROM customer), v AS (SELECT user_id AS entity_id, max(ts) AS at_ts FROM events GROUP BY user_id)\n"


@query("stale_entities", "11.6", _ENT + "SELECT u.entity_id FROM u LEFT JOIN v USING (entity_id) WHERE at_ts IS NULL OR at_ts < TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR")
def _(spark: SparkSession, sf: str) -> DataFrame:
    entities = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    values = inputs.table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("computed_at"))
    return versions.stale_entities(entities, values, F.lit("2024-01-31").cast("timestamp_ntz"), 36)


@query(
    "incremental_compute",
    "11.8",
    _ENT + "SELECT u.entity_id, CASE WHEN at_ts IS NULL OR at_ts < TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR THEN 1e0 ELSE 0e0 END AS value FROM u LEFT JOIN v USING (entity_id)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    entities = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    values = inputs.table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id")).agg(F.lit(0.0).alias("value"), F.max("ts").alias("computed_at"))
    values = values.join(entities, "entity_id", "left_semi")
    out = versions.run_incremental(entities, values, now, 36, lambda stale: stale.withColumns({"value": F.lit(1.0), "computed_at": now}))
    return out.select("entity_id", "value")


@query(
    "feature_vectors",
    "11.7",
    MW
    + """SELECT match_id, round(odds_h, 6) AS odds, round(h.v, 6) AS home_strength, round(a.v, 6) AS away_strength FROM matches JOIN (SELECT n_name, n_nationkey * 1.5e0 AS v FROM nation) h ON h.n_name = home_team JOIN (SELECT n_name, n_nationkey * 1.5e0 AS v FROM nation) a ON a.n_name = away_team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    n = inputs.table(spark, sf, "nation")
    ids = n.select(F.col("n_name").alias("home_team"), F.col("n_nationkey").cast("long").alias("home_id"))
    away = ids.withColumnsRenamed({"home_team": "away_team", "home_id": "away_id"})
    fixtures = m.join(ids, "home_team").join(away, "away_team").select("match_id", "home_id", "away_id")
    values = m.select(F.lit("odds").alias("feature"), F.lit("match").alias("entity_type"), F.col("match_id").alias("entity_id"), F.col("odds_h").alias("value")).unionByName(
        n.select(F.lit("strength").alias("feature"), F.lit("team").alias("entity_type"), F.col("n_nationkey").cast("long").alias("entity_id"), (F.col("n_nationkey") * 1.5).alias("value"))
    )
    return rounded(versions.assemble_vectors(values, fixtures, ["odds"], ["strength"]), ["match_id"], ["odds", "home_strength", "away_strength"])


@query(
    "feature_values_lookup",
    "11.16",
    "SELECT event_type AS feature, user_id AS entity_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = inputs.table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.col("user_id").alias("entity_id"))
    entities = inputs.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity_id"))
    return versions.values_for(values, entities, ["click", "view"]).groupBy("feature", "entity_id").agg(F.count("*").alias("n"))


@query(
    "feature_value_rules",
    "11.9",
    """WITH v AS (SELECT event_type AS feature, user_id AS entity_id, CASE WHEN value > 300 THEN NULL ELSE value END AS value FROM events),
e AS (SELECT feature, entity_id, count(*) - count(value) AS nulls, count(*) FILTER (value < 1 OR value > 200) AS o, min(value) <> max(value) AS c FROM v GROUP BY ALL), d AS (SELECT feature, count(DISTINCT value) AS d FROM v GROUP BY feature)
SELECT e.feature, CAST(sum(o) AS BIGINT) AS out_of_range, CAST(sum(nulls) AS BIGINT) AS nulls, count(*) FILTER (c) AS conflicts, max(d) AS "distinct", max(d) < 500 AS too_few_values FROM e JOIN d ON d.feature = e.feature GROUP BY e.feature""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = inputs.table(spark, sf, "events").selectExpr("event_type AS feature", "user_id AS entity_id", "CASE WHEN value > 300 THEN NULL ELSE value END AS value")
    return versions.feature_value_rules(values, 1.0, 200.0, 500)


@query(
    "definition_versions",
    "11.18",
    """WITH d AS (SELECT p_name AS name, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS INT) AS version FROM part), x AS (SELECT min(p_name) AS name FROM part)
SELECT name, version FROM d UNION ALL SELECT x.name, CAST(max(version) + 1 AS INT) FROM x JOIN d USING (name) GROUP BY x.name""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = inputs.table(spark, sf, "part")
    d = p.select(F.col("p_name").alias("name"), F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")).alias("version"), F.lit("").alias("changelog"))
    name = p.agg(F.min("p_name")).first()[0]
    return versions.new_definition_version(d, name, "new range").select("name", "version")


# Lineage: region -> nation -> supplier -> part, from the lines that name them.
_EDGES = """WITH RECURSIVE e AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS parent, 'n' || CAST(n_nationkey AS VARCHAR) AS child FROM nation UNION SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier
 UNION SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem)
"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n, s, line = (inputs.table(spark, sf, t) for t in ("nation", "supplier", "lineitem"))

    def edge(df: DataFrame, a: str, ac: str, b: str, bc: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(ac).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(bc).cast("string")).alias("child")).distinct()

    out = edge(n, "r", "n_regionkey", "n", "n_nationkey").unionByName(edge(s, "n", "s_nationkey", "s", "s_suppkey"))
    return out.unionByName(edge(line, "s", "l_suppkey", "p", "l_partkey"))


@query("lineage_sources", "4.35", _EDGES + "SELECT parent, count(DISTINCT child) AS features FROM e GROUP BY parent")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return versions.source_summary(_edges(spark, sf))


@query(
    "lineage_downstream",
    "11.10",
    _EDGES + ", w AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS start, 'r' || CAST(r_regionkey AS VARCHAR) AS node, 0 AS depth FROM region UNION SELECT start, child, depth + 1 FROM w JOIN e ON e.parent = w.node) SELECT start, node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    start = inputs.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return versions.reachable(_edges(spark, sf), start)


@query(
    "lineage_upstream",
    "11.17",
    _EDGES + ", w AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS start, 's' || CAST(s_suppkey AS VARCHAR) AS node, 0 AS depth FROM supplier UNION SELECT start, parent, depth + 1 FROM w JOIN e ON e.child = w.node) SELECT start, node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    start = inputs.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return versions.reachable(_edges(spark, sf), start, upstream=True)


@query(
    "window_chain_append",
    "11.19",
    MW + "SELECT match_date, home_team, away_team, max(match_id) AS match_id FROM matches GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.clean import dedupe_latest

    m = inputs.matches(spark, sf).select("match_date", "home_team", "away_team", "match_id", "season")
    history = written(m.filter("season <= 1998").drop("season"), "history")
    both = history.unionByName(m.filter("season >= 1998").drop("season"))
    return dedupe_latest(both, ["match_date", "home_team", "away_team"], "match_id")
