"""Ratings, goal models and market probabilities from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import goals as G
from touchline.operators import aggregates, goal_models, ratings
from touchline.plans import inputs
from touchline.plans.common import rounded, rsql
from touchline.plans.registry import query
from touchline.sources.shared import written

MW = inputs.sql_with("matches")
RW = MW.replace("WITH ", "WITH RECURSIVE ", 1)

# The rating fold in SQL: a list of a pool's matches reduced over a map of ratings.
_K_XG = "CASE WHEN abs(home_xg - away_xg) > 0 THEN 32 * ln(1 + least(abs(home_xg - away_xg), 5)) WHEN home_goals <> away_goals THEN 32 * ln(1 + least(abs(home_goals - away_goals), 5)) ELSE 32e0 END"
_K_FRAME = "20 * least(greatest(ln(1 + least(abs(home_goals - away_goals), 5)), 0.5), 3.0)"


def _elo_sql(pool: str, k: str, initial: float) -> str:
    gap = f"x.k * (x.s - 1 / (1 + pow(10e0, (coalesce(b[x.a], {initial}e0) - coalesce(b[x.h], {initial}e0) - 100) / 400)))"
    regressed = (
        "CASE WHEN acc.y = x.y OR acc.y = 0 THEN acc.m ELSE map_from_entries(list_transform(map_entries(acc.m), "
        "lambda e: {'k': e.key, 'v': list_avg(map_values(acc.m)) + (e.value - list_avg(map_values(acc.m))) * (2e0 / 3)})) END"
    )
    return (
        MW
        + f""", k AS (SELECT {pool} AS pool, {k} AS k, CASE result WHEN 'H' THEN 1e0 WHEN 'D' THEN 0.5e0 ELSE 0e0 END AS s, * FROM matches),
l AS (SELECT pool, list({{'h': home_team, 'a': away_team, 's': s, 'k': CAST(k AS DOUBLE), 'y': season}} ORDER BY match_date, match_id) AS l FROM k GROUP BY pool),
st AS (SELECT pool, list_reduce(l, lambda acc, x: {{'m': list_transform([{regressed}], lambda b: map_concat(b, MAP {{x.h: coalesce(b[x.h], {initial}e0) + {gap}, x.a: coalesce(b[x.a], {initial}e0) - {gap}}}))[1], 'y': x.y}},
 {{'m': MAP([]::VARCHAR[], []::DOUBLE[]), 'y': 0}}) AS r FROM l),
e AS (SELECT pool, unnest(map_entries(r.m)) AS e FROM st)
SELECT pool, e.key AS team, round(e.value, 6) AS rating FROM e"""
    )


@query("elo_by_league", "6.1 6.2 6.3 6.7", _elo_sql("league", _K_XG, 1500))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.elo(inputs.matches(spark, sf), "league", final=True), ["pool", "team"], ["rating"])


@query("elo_framework", "6.6 6.7 6.8", _elo_sql("league", _K_FRAME, 1300))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.elo_framework(inputs.matches(spark, sf), "league", final=True), ["pool", "team"], ["rating"])


@query("elo_single_pool", "6.1 6.3", _elo_sql("'all'", _K_XG, 1500))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.elo(inputs.matches(spark, sf), final=True), ["pool", "team"], ["rating"])


# One match of every pool a step, so that each step's ratings can be seen.
_STEPS = (
    RW
    + f""", k AS (SELECT league AS pool, CAST({_K_XG} AS DOUBLE) AS k, CASE result WHEN 'H' THEN 1e0 WHEN 'D' THEN 0.5e0 ELSE 0e0 END AS s, home_team AS h, away_team AS a, season AS y, match_id,
 row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS i FROM matches),
st AS (SELECT CAST(0 AS BIGINT) AS i, pool, MAP([]::VARCHAR[], []::DOUBLE[]) AS m, 0 AS y, CAST(NULL AS BIGINT) AS match_id, '' AS h, '' AS a, 0e0 AS hb, 0e0 AS ab, 0e0 AS d FROM (SELECT DISTINCT pool FROM k) UNION ALL
 SELECT i, pool, map_concat(r, MAP {{h: hb + d, a: ab - d}}), y, match_id, h, a, hb, ab, d FROM
 (SELECT *, k * (s - 1 / (1 + pow(10e0, (ab - hb - 100) / 400))) AS d FROM (SELECT *, coalesce(r[h], 1500e0) AS hb, coalesce(r[a], 1500e0) AS ab FROM
 (SELECT k.*, CASE WHEN st.y = k.y OR st.y = 0 THEN st.m ELSE map_from_entries(list_transform(map_entries(st.m), lambda e: {{'k': e.key, 'v': list_avg(map_values(st.m)) + (e.value - list_avg(map_values(st.m))) * (2e0 / 3)}})) END AS r
  FROM st JOIN k ON k.pool = st.pool AND k.i = st.i + 1))))
"""
)


@query(
    "elo_history",
    "6.9 6.1",
    _STEPS
    + """SELECT pool, match_id, h AS team, round(hb, 6) AS before, round(hb + d, 6) AS after, round(d, 6) AS change FROM st WHERE i > 0
 UNION ALL SELECT pool, match_id, a, round(ab, 6), round(ab - d, 6), round(-d, 6) FROM st WHERE i > 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = ratings.team_ratings(ratings.elo(inputs.matches(spark, sf), "league"))
    return rounded(out, ["pool", "match_id", "team"], ["before", "after", "change"])


@query("elo_top_teams", "6.9", _elo_sql("'all'", _K_XG, 1500) + " ORDER BY e.value DESC, team LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.top_rated(ratings.elo(inputs.matches(spark, sf), final=True)), ["pool", "team"], ["rating"])


# Ratings given per nation, so the prediction formulas have an independent check.
_RATED = "CAST(1400 + (n_nationkey * 17) % 200 AS DOUBLE)"


@query(
    "elo_predictions",
    "6.4 6.5 6.22",
    MW
    + f""", r AS (SELECT n_name AS team, {_RATED} AS rating FROM nation WHERE n_nationkey > 2),
j AS (SELECT match_id, coalesce(h.rating, 1500) AS h, coalesce(a.rating, 1500) AS a FROM matches LEFT JOIN r h ON h.team = home_team LEFT JOIN r a ON a.team = away_team),
e AS (SELECT *, 1 / (1 + pow(10e0, (a - h - 100) / 400)) AS x, greatest(1 + (h - a) / 400, 0.1) AS lam, greatest(2 - (1 + (h - a) / 400), 0.1) AS mu FROM j)
SELECT match_id, round(x - 0.125 * (1 - abs(2 * x - 1)), 6) AS p_home, round(0.25 * (1 - abs(2 * x - 1)), 6) AS p_draw, round(1 - x - 0.125 * (1 - abs(2 * x - 1)), 6) AS p_away,
 round(1 - exp(-lam) - exp(-mu) + exp(-lam - mu), 6) AS p_btts FROM e""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.table(spark, sf, "nation").filter("n_nationkey > 2").selectExpr("n_name AS team", f"{_RATED} AS rating")
    out = ratings.predict_from_ratings(inputs.matches(spark, sf), r)
    return rounded(out, ["match_id"], ["p_home", "p_draw", "p_away", "p_btts"])


@query(
    "elo_k_factors",
    "6.7 6.8",
    MW
    + f"""SELECT match_id, round({_K_XG}, 6) AS k_margin, round({_K_FRAME} * CASE match_id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 2 THEN 0.5 ELSE 1 END, 6) AS k_framework,
 CASE match_id % 3 WHEN 0 THEN 1.1e0 WHEN 1 THEN 1.0e0 ELSE 1.2e0 END AS tier FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).selectExpr(
        "*", "CASE match_id % 4 WHEN 0 THEN 'World_Cup' WHEN 1 THEN 'world cup qualifier' WHEN 2 THEN 'Club Friendly' ELSE 'other' END AS comp",
        "CASE match_id % 3 WHEN 0 THEN 'Ligue 2' WHEN 1 THEN 'Premier League' ELSE 'League Two' END AS div",
    )
    margin = F.abs(F.col("home_goals") - F.col("away_goals"))
    out = m.select(
        "match_id", G.elo_k(32.0, margin, F.abs(F.col("home_xg") - F.col("away_xg"))).alias("k_margin"),
        G.elo_framework_k(20.0, margin, G.match_importance(F.col("comp")), F.lit(1.0)).alias("k_framework"), G.tier_factor(F.col("div")).alias("tier"),
    )
    return rounded(out, ["match_id", "tier"], ["k_margin", "k_framework"])


# Four ratings of each team (attack and defence at home, then away) moved match by match.
_STAT_STEPS = (
    RW
    + """, v AS (SELECT unnest([home_sot, away_sot]) AS v FROM matches), c AS (SELECT avg(v) AS mean, CASE WHEN stddev_pop(v) >= 0.1 THEN stddev_pop(v) ELSE 1 END AS spread FROM v),
k AS (SELECT league AS pool, home_team AS h, away_team AS a, match_id, row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS i, mean, spread,
 least(greatest((home_sot - mean) / spread, -5), 5) AS oh, least(greatest((away_sot - mean) / spread, -5), 5) AS oa, greatest(pow(2e0, -datediff('day', match_date, (SELECT max(match_date) + 1 FROM matches)) / 365e0), 0.01) AS w FROM matches, c),
st AS (SELECT CAST(0 AS BIGINT) AS i, pool, MAP([]::VARCHAR[], []::DOUBLE[][]) AS m, CAST(NULL AS BIGINT) AS match_id, 0e0 AS eh, 0e0 AS ea FROM (SELECT DISTINCT pool FROM k) UNION ALL
 SELECT i, pool, map_concat(m, MAP {{h: [x[1] + {rate} * w * (oh - eh), x[2] + {rate} * w * (oa - ea), x[3], x[4]], a: [z[1], z[2], z[3] + {rate} * w * (oa - ea), z[4] + {rate} * w * (oh - eh)]}}), match_id, greatest(eh * spread + mean, 0.01), greatest(ea * spread + mean, 0.01) FROM
 (SELECT *, (x[1] + z[4]) / 2 AS eh, (z[3] + x[2]) / 2 AS ea FROM (SELECT k.*, st.m, coalesce(st.m[h], [5.5e0, 5.5e0, 5e0, 5e0]) AS x, coalesce(st.m[a], [5.5e0, 5.5e0, 5e0, 5e0]) AS z FROM st JOIN k ON k.pool = st.pool AND k.i = st.i + 1)))
"""
)


@query(
    "stat_ratings_slow",
    "6.10 6.11",
    _STAT_STEPS.format(rate="0.05e0") + "SELECT match_id, round(eh, 4) AS exp_home, round(ea, 4) AS exp_away FROM st WHERE i > 0",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.stat_rating_history(inputs.matches(spark, sf), "sot", "league", ratings.StatRules(k=0.05)), ["match_id"], ["exp_home", "exp_away"], 4)


@query("stat_ratings", "6.10 6.11")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.stat_rating_history(inputs.matches(spark, sf), "sot", "league"), ["match_id"], ["exp_home", "exp_away"], 4)


@query("stat_rating_over_model", "6.10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    used = ["match_id", "match_date", "league", "home_team", "away_team", "home_sot", "away_sot", "home_goals", "away_goals"]
    m = written(inputs.matches(spark, sf).select(*used), "matches")  # rated, and joined to its ratings
    model, frame = ratings.stat_rating_over_model(m, ratings.stat_rating_history(m, "sot", "league", ratings.StatRules(k=0.05)))
    return model.transform(frame).select("match_id", F.round(vector_to_array("probability")[1], 4).alias("p_over"))


# Goal rates per match as given numbers: expected goals plus a floor.
_LAM, _MU = "(home_xg + 0.2e0)", "(away_xg + 0.2e0)"
_RHO = 0.08


def _grid(n: int, rho: float) -> str:
    return f""", g AS (SELECT i, j FROM (SELECT unnest(range(0, {n + 1})) AS i) a, (SELECT unnest(range(0, {n + 1})) AS j) b),
c AS (SELECT match_id, i, j, greatest(exp(-{_LAM}) * pow({_LAM}, i) / factorial(CAST(i AS INT)) * exp(-{_MU}) * pow({_MU}, j) / factorial(CAST(j AS INT))
 * CASE WHEN i = 0 AND j = 0 THEN 1 - {_LAM} * {_MU} * {rho} WHEN i = 0 AND j = 1 THEN 1 + {_LAM} * {rho} WHEN i = 1 AND j = 0 THEN 1 + {_MU} * {rho} WHEN i = 1 AND j = 1 THEN 1 - {rho} ELSE 1 END, 0) AS p FROM matches, g),
t AS (SELECT match_id, sum(p) AS t FROM c GROUP BY match_id)
"""


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.matches(spark, sf).selectExpr("match_id", "home_goals", "away_goals", "league", f"{_LAM} AS lam", f"{_MU} AS mu")


@query(
    "scoreline_grid",
    "6.14 2.32 2.34",
    MW + _grid(6, _RHO) + "SELECT c.match_id, CAST(i AS INT) AS home_score, CAST(j AS INT) AS away_score, round(p / t, 8) AS probability FROM c JOIN t USING (match_id)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(goal_models.score_table(_rated(spark, sf), _RHO), ["match_id", "home_score", "away_score"], ["probability"], 8)


_MARKETS = {
    "home_win": "sum(p) FILTER (i > j) / max(t)", "draw": "sum(p) FILTER (i = j) / max(t)", "away_win": "sum(p) FILTER (i < j) / max(t)",
    "over_2_5": "sum(p) FILTER (i + j > 2.5) / max(t)", "over_3_5": "sum(p) FILTER (i + j > 3.5) / max(t)",
    "btts": f"max(1 - exp(-{_LAM}) - exp(-{_MU}) + exp(-{_LAM} - {_MU}))",
}


def _market_sql(rho: float) -> str:
    return (
        MW
        + _grid(10, rho)
        + f"SELECT c.match_id, {rsql(_MARKETS)}, arg_max(CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR), (p, -i, -j)) AS most_likely_score FROM c JOIN t USING (match_id) JOIN matches m ON m.match_id = c.match_id GROUP BY c.match_id"
    )


@query("score_markets", "6.15 9.9", _market_sql(_RHO))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.with_score_markets(_rated(spark, sf), "lam", "mu", _RHO, 10), ["match_id", "most_likely_score"], list(_MARKETS))


@query("score_markets_independent", "6.16", _market_sql(0.0))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.with_score_markets(_rated(spark, sf), "lam", "mu", 0.0, 10), ["match_id", "most_likely_score"], list(_MARKETS))


@query(
    "expected_points",
    "5.21",
    MW
    + _grid(8, 0.0)
    + "SELECT c.match_id, round(3 * sum(p) FILTER (i > j) / max(t) + sum(p) FILTER (i = j) / max(t), 6) AS h_xpts, round(3 * sum(p) FILTER (i < j) / max(t) + sum(p) FILTER (i = j) / max(t), 6) AS a_xpts FROM c JOIN t USING (match_id) GROUP BY c.match_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.expected_points(_rated(spark, sf), "lam", "mu"), ["match_id"], ["h_xpts", "a_xpts"])


@query(
    "poisson_distribution",
    "2.32 2.33 2.34",
    MW
    + f"""SELECT match_id, round(exp(-{_LAM}) * pow({_LAM}, home_goals) / factorial(home_goals), 9) AS pmf, round(list_sum(list_transform(range(0, away_goals + 1), lambda k: exp(-{_MU}) * pow({_MU}, k) / factorial(CAST(k AS INT)))), 9) AS cdf,
 round(CASE WHEN home_goals = 0 AND away_goals = 0 THEN 1 - {_LAM} * {_MU} * 0.1 WHEN home_goals = 0 AND away_goals = 1 THEN 1 + {_LAM} * 0.1 WHEN home_goals = 1 AND away_goals = 0 THEN 1 + {_MU} * 0.1 WHEN home_goals = 1 AND away_goals = 1 THEN 0.9 ELSE 1 END, 9) AS tau FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = _rated(spark, sf).select(
        "match_id", G.poisson_pmf(F.col("home_goals"), F.col("lam")).alias("pmf"), G.poisson_cdf(F.col("away_goals"), F.col("mu")).alias("cdf"),
        G.low_score_factor(F.col("home_goals"), F.col("away_goals"), F.col("lam"), F.col("mu"), F.lit(0.1)).alias("tau"),
    )
    return rounded(out, ["match_id"], ["pmf", "cdf", "tau"], 9)


_PP = "OVER (PARTITION BY {k} ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ASOF = {
    "expected_home_goals": "mh * hs * ac", "expected_away_goals": "ma * ats * hc", "expected_total_goals": "mh * hs * ac + ma * ats * hc",
    "expected_goal_difference": "mh * hs * ac - ma * ats * hc", "home_attack": "hs", "home_defence": "hc", "away_attack": "ats", "away_defence": "ac",
}


def _poisson_sql(halflife: int) -> str:
    return MW + f""", w AS (SELECT *, pow(2e0, datediff('day', DATE '1999-01-01', match_date) / {halflife}e0) AS w FROM matches),
l AS (SELECT *, coalesce(sum(w * home_goals) {_PP.format(k="'x'")} / sum(w) {_PP.format(k="'x'")}, 0) AS mh, coalesce(sum(w * away_goals) {_PP.format(k="'x'")} / sum(w) {_PP.format(k="'x'")}, 0) AS ma FROM w),
g AS (SELECT match_id, match_date, home_team AS team, home_goals AS s, away_goals AS c, w, 1 AS h FROM w UNION ALL SELECT match_id, match_date, away_team, away_goals, home_goals, w, 0 FROM w),
t AS (SELECT match_id, h, sum(w * s) {_PP.format(k="team")} / sum(w) {_PP.format(k="team")} AS s, sum(w * c) {_PP.format(k="team")} / sum(w) {_PP.format(k="team")} AS c FROM g),
j AS (SELECT l.match_id, mh, ma, CASE WHEN mh + ma > 0 THEN coalesce(th.s / ((mh + ma) / 2), 1) ELSE 1 END AS hs, CASE WHEN mh + ma > 0 THEN coalesce(th.c / ((mh + ma) / 2), 1) ELSE 1 END AS hc,
 CASE WHEN mh + ma > 0 THEN coalesce(ta.s / ((mh + ma) / 2), 1) ELSE 1 END AS ats, CASE WHEN mh + ma > 0 THEN coalesce(ta.c / ((mh + ma) / 2), 1) ELSE 1 END AS ac
 FROM l JOIN t th ON th.match_id = l.match_id AND th.h = 1 JOIN t ta ON ta.match_id = l.match_id AND ta.h = 0)
SELECT match_id, {rsql(_ASOF)} FROM j"""


@query("poisson_as_of", "5.22", _poisson_sql(180))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(goal_models.poisson_as_of(inputs.matches(spark, sf)), ["match_id"], list(_ASOF))


@query("poisson_as_of_short", "5.22", _poisson_sql(7))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(goal_models.poisson_as_of(inputs.matches(spark, sf), 7.0), ["match_id"], list(_ASOF))



# A weighted likelihood climbed in SQL by small steps of all parameters at once, from pair sums `p` (k, h, a, w, hg, ag, low scores).
_LOW_SUMS = ", ".join(f"sum(CASE WHEN {{h}} = {i} AND {{a}} = {j} THEN w ELSE 0e0 END) AS w{i}{j}" for i in (0, 1) for j in (0, 1))


def _pairs_sql(source: str, key: str, home: str = "home_goals", away: str = "away_goals") -> str:
    low = _LOW_SUMS.format(h=home, a=away)
    return f"SELECT {key} AS k, home_team AS h, away_team AS a, sum(w) AS w, sum(w * {home}) AS hg, sum(w * {away}) AS ag, {low} FROM {source} GROUP BY ALL"


def _fit_sql(ridge: float, rho: bool, steps: int = 6000) -> str:
    r = 2 * ridge
    none = "w00 * -lam * mu * rh / (1 - lam * mu * rh)"
    slope = "sum(-w00 * lam * mu / (1 - lam * mu * rh) + w01 * lam / (1 + lam * rh) + w10 * mu / (1 + mu * rh) - w11 / (1 - rh))"
    bend = "sum(w00 * pow(lam * mu / (1 - lam * mu * rh), 2) + w01 * pow(lam / (1 + lam * rh), 2) + w10 * pow(mu / (1 + mu * rh), 2) + w11 / pow(1 - rh, 2))"
    return f""", tm AS (SELECT k, team, team = min(team) OVER (PARTITION BY k) AS fixed FROM (SELECT DISTINCT k, unnest([h, a]) AS team FROM p)),
st AS (SELECT 0 AS i, k, team, fixed, 0e0 AS al, 0e0 AS be, 0e0 AS ga, 0e0 AS rh FROM tm UNION ALL
 (WITH r AS (SELECT p.*, x.rh, exp(x.al + y.be + x.ga) AS lam, exp(y.al + x.be) AS mu FROM p JOIN st x ON x.k = p.k AND x.team = p.h JOIN st y ON y.k = p.k AND y.team = p.a),
 t AS (SELECT *, {f"{none} + w01 * lam * rh / (1 + lam * rh)" if rho else "0e0"} AS th, {f"{none} + w10 * mu * rh / (1 + mu * rh)" if rho else "0e0"} AS ta FROM r),
 s AS (SELECT k, team, sum(g) AS g, sum(f) AS f, sum(c) AS c, sum(d) AS d FROM (SELECT k, h AS team, hg + th AS g, w * lam AS f, ag + ta AS c, w * mu AS d FROM t UNION ALL SELECT k, a, ag + ta, w * mu, hg + th, w * lam FROM t) GROUP BY k, team),
 e AS (SELECT k, sum(hg + th - w * lam) / sum(w * lam) AS dg, {f"{slope} / {bend}" if rho else "0e0"} AS dr FROM t GROUP BY k)
 SELECT i + 1, st.k, st.team, fixed, CASE WHEN fixed THEN 0e0 ELSE al + 0.45 * (g - f - {r} * al) / (f + {r}) END, CASE WHEN fixed THEN 0e0 ELSE be + 0.45 * (c - d - {r} * be) / (d + {r}) END, ga + 0.45 * dg, rh + 0.45 * dr
 FROM st JOIN s ON s.k = st.k AND s.team = st.team JOIN e ON e.k = st.k WHERE i < {steps})),
fit AS (SELECT * FROM st WHERE i = {steps})
"""


_WHOLE = RW + ", m AS (SELECT *, 1e0 AS w FROM matches), p AS MATERIALIZED (" + _pairs_sql("m", "'whole'") + ")"


def _whole_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return written(goal_models.pair_sums(inputs.matches(spark, sf).withColumn("model", F.lit("whole")), keys=("model",)), "pairs")


@query("dixon_coles_fit", "6.12 6.18", _WHOLE + _fit_sql(0.0, True) + "SELECT team, round(al, 4) AS alpha, round(be, 4) AS beta, round(ga, 4) AS gamma, round(rh, 4) AS rho FROM fit")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(goal_models.fit_goal_models(_whole_pairs(spark, sf), ["model"]), ["team"], ["alpha", "beta", "gamma", "rho"], 4)


@query(
    "goal_fit_balances",
    "6.12",
    MW
    + """, g AS (SELECT home_team AS team, home_goals AS s, away_goals AS c FROM matches UNION ALL SELECT away_team, away_goals, home_goals FROM matches)
SELECT team, sum(s)::DOUBLE AS scored, sum(c)::DOUBLE AS conceded, CASE WHEN team > min(team) OVER () THEN 0e0 END AS scored_left, CASE WHEN team > min(team) OVER () THEN 0e0 END AS conceded_left FROM g GROUP BY team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _whole_pairs(spark, sf)
    out = goal_models.balances(pairs, goal_models.fit_goal_models(pairs, ["model"]), ["model"])
    return rounded(out, ["team"], ["scored", "conceded", "scored_left", "conceded_left"], 2)


_FADE = "exp(-0.6931471805599453e0 * greatest(datediff('day', match_date, {ref}), 0) / {halflife}e0)"


def _as_of_sql(blocks: str) -> str:
    """Rates of each match of a block from the fit on all blocks before it, faded to its start; `blocks` adds `block` to the matches."""
    return (
        RW
        + f""", t AS ({blocks}), b AS (SELECT block AS upto, min(match_date) AS start FROM t GROUP BY block),
m AS (SELECT t.*, b.upto, {_FADE.format(ref="b.start", halflife=365)} AS w FROM t JOIN b ON t.block < b.upto), p AS MATERIALIZED ({_pairs_sql("m", "upto")})"""
        + _fit_sql(0.02, True, 5000)
        + """, e AS (SELECT k, max(ga) AS ga, max(rh) AS rh FROM fit GROUP BY k),
q AS (SELECT t.match_id, t.block, e.rh, exp(coalesce(x.al, 0) + coalesce(y.be, 0) + e.ga) AS lam, exp(coalesce(y.al, 0) + coalesce(x.be, 0)) AS mu
 FROM t JOIN e ON e.k = t.block LEFT JOIN fit x ON x.k = t.block AND x.team = home_team LEFT JOIN fit y ON y.k = t.block AND y.team = away_team)
"""
    )


_CELLS = """, g AS (SELECT i, j FROM (SELECT unnest(range(0, 9)) AS i) a, (SELECT unnest(range(0, 9)) AS j) b),
c AS (SELECT match_id, block, lam, mu, i, j, greatest(exp(-lam) * pow(lam, i) / factorial(CAST(i AS INT)) * exp(-mu) * pow(mu, j) / factorial(CAST(j AS INT))
 * CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * rh WHEN i = 0 AND j = 1 THEN 1 + lam * rh WHEN i = 1 AND j = 0 THEN 1 + mu * rh WHEN i = 1 AND j = 1 THEN 1 - rh ELSE 1 END, 0) AS p FROM q, g)
"""
_CELL_MARKETS = {
    "lam": "max(lam)", "mu": "max(mu)", "home_win": "sum(p) FILTER (i > j) / sum(p)", "draw": "sum(p) FILTER (i = j) / sum(p)", "away_win": "sum(p) FILTER (i < j) / sum(p)",
    "over_2_5": "sum(p) FILTER (i + j > 2.5) / sum(p)", "btts": "max(1 - exp(-lam) - exp(-mu) + exp(-lam - mu))",
}


@query(
    "dixon_coles_markets",
    "6.13 6.15 6.19",
    _as_of_sql("SELECT *, season AS block FROM matches") + _CELLS + f"SELECT match_id, block, {rsql(_CELL_MARKETS, 3)}, arg_max(CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR), p) AS most_likely_score FROM c GROUP BY match_id, block",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rated = goal_models.as_of_rates(written(inputs.matches(spark, sf), "matches"), F.col("season")).filter("lam IS NOT NULL")
    out = G.with_score_markets(rated.select("match_id", "block", "lam", "mu", "rho"), "lam", "mu", F.col("rho"), 8)
    return rounded(out, ["match_id", "block", "most_likely_score"], list(_CELL_MARKETS), 3)


@query(
    "dixon_coles_refits",
    "6.13 6.20",
    _as_of_sql(
        "SELECT *, CASE WHEN f < 2000 THEN 0 WHEN f < 6000 THEN 1 WHEN f < 11000 THEN 2 ELSE 3 + (f - 11000) // 5000 END AS block FROM "
        "(SELECT *, min(r) OVER (PARTITION BY match_date) AS f FROM (SELECT *, row_number() OVER (ORDER BY match_date, match_id) - 1 AS r FROM matches) x) y"
    )
    + "SELECT match_id, CAST(block AS BIGINT) AS block, round(lam, 3) AS lam, round(mu, 3) AS mu FROM q",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    blocks = written(goal_models.refit_blocks(inputs.matches(spark, sf), 2000), "matches")
    return rounded(goal_models.as_of_rates(blocks, F.col("block")).filter("lam IS NOT NULL"), ["match_id", "block"], ["lam", "mu"], 3)


@query(
    "goal_model_per_league",
    "6.18 6.23 6.20",
    RW
    + f""", d AS (SELECT *, {_FADE.format(ref="(SELECT max(match_date) + 1 FROM matches)", halflife=365)} AS w FROM matches), m AS (SELECT *, league AS model FROM d UNION ALL SELECT *, '*' FROM d),
p AS MATERIALIZED ({_pairs_sql("m", "model")})"""
    + _fit_sql(0.02, True, 6000)
    + """, n AS (SELECT league, CASE WHEN count(*) >= 50 THEN league ELSE '*' END AS model FROM matches GROUP BY league), e AS (SELECT k, max(ga) AS ga FROM fit GROUP BY k)
SELECT match_id, n.model AS model_league, round(exp(coalesce(x.al, 0) + coalesce(y.be, 0) + e.ga), 4) AS lam, round(exp(coalesce(y.al, 0) + coalesce(x.be, 0)), 4) AS mu
 FROM matches JOIN n USING (league) JOIN e ON e.k = n.model LEFT JOIN fit x ON x.k = n.model AND x.team = home_team LEFT JOIN fit y ON y.k = n.model AND y.team = away_team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = goal_models.per_league_rates(inputs.matches(spark, sf))
    return rounded(out, ["match_id", "model_league"], ["lam", "mu"], 4)


@query(
    "xg_strength_model",
    "6.17 6.19",
    RW
    + f""", m AS (SELECT *, greatest({_FADE.format(ref="(SELECT max(match_date) + 1 FROM matches)", halflife=730)}, 1e-6) AS w FROM matches),
p AS MATERIALIZED ({_pairs_sql("m", "'all'", "home_xg", "away_xg")})"""
    + _fit_sql(0.02, False)
    + "SELECT team, round(al, 4) AS alpha, round(be, 4) AS beta, round(ga, 4) AS gamma FROM fit",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.clean import recency_weight

    m = inputs.matches(spark, sf)
    dated = m.withColumn("_ref", m.agg(F.date_add(F.max("match_date"), 1)).scalar()).withColumn("model", F.lit("all"))
    w = F.greatest(recency_weight(F.col("match_date"), F.col("_ref"), 730.0), F.lit(1e-6))
    pairs = written(goal_models.pair_sums(dated, "home_xg", "away_xg", w, ("model",)), "pairs")
    return rounded(goal_models.fit_goal_models(pairs, ["model"], 0.02, with_rho=False), ["team"], ["alpha", "beta", "gamma"], 4)


_STRENGTH = """, mu AS (SELECT avg(home_goals) AS h, avg(away_goals) AS a FROM matches),
gg AS (SELECT home_team AS team, home_goals AS s, away_goals AS c FROM matches UNION ALL SELECT away_team, away_goals, home_goals FROM matches),
ts AS (SELECT team, avg(s) / max((h + a) / 2) AS att, avg(c) / max((h + a) / 2) AS def FROM gg, mu GROUP BY team),
r AS (SELECT match_id, result, mu.h * x.att * y.def AS lam, mu.a * y.att * x.def AS m FROM matches, mu, ts x, ts y WHERE x.team = home_team AND y.team = away_team),
g AS (SELECT i, j FROM (SELECT unnest(range(0, 11)) AS i) a, (SELECT unnest(range(0, 11)) AS j) b),
c AS (SELECT match_id, result, i, j, exp(-lam) * pow(lam, i) / factorial(CAST(i AS INT)) * exp(-m) * pow(m, j) / factorial(CAST(j AS INT)) AS p FROM r, g),
o AS (SELECT match_id, result, sum(p) FILTER (i > j) / sum(p) AS ph, sum(p) FILTER (i = j) / sum(p) AS pd, sum(p) FILTER (i < j) / sum(p) AS pa FROM c GROUP BY ALL)
"""


@query(
    "poisson_evaluation",
    "6.21 6.16 4.9",
    MW
    + _STRENGTH
    + """SELECT count(*) AS n, round(avg(CAST(CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pd >= pa THEN 'D' ELSE 'A' END = result AS INT)), 6) AS accuracy,
 round(avg(pow(CAST(result = 'H' AS INT) - ph, 2) + pow(CAST(result = 'D' AS INT) - pd, 2) + pow(CAST(result = 'A' AS INT) - pa, 2)), 6) AS brier,
 round(avg(-ln(CASE result WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END)), 6) AS log_loss FROM o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators import evaluation

    m = inputs.matches(spark, sf)
    averages = m.agg(F.avg("home_goals").alias("home"), F.avg("away_goals").alias("away"))
    out = goal_models.predict_poisson(m, aggregates.poisson_strengths(m), averages)
    named = out.withColumnsRenamed({"home_win": "p_h", "draw": "p_d", "away_win": "p_a"})
    return rounded(evaluation.outcome_metrics(named, []), ["n"], ["accuracy", "brier", "log_loss"])
