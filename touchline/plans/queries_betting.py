"""Market features, value bets, staking, backtests and risk limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import odds as O
from touchline.operators import bets, market, risk
from touchline.plans import inputs
from touchline.plans.common import rounded, rsql
from touchline.plans.registry import query

MW = inputs.sql_with("matches")
MB = inputs.sql_with("matches", "books")
MP = inputs.sql_with("matches", "preds")
ODDS = ("match_date", "league", "season", "home_team", "away_team", "home_goals", "away_goals", "result", "odds_h", "odds_d", "odds_a", "close_h", "close_d", "close_a", "status")


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.preds(spark, sf, ODDS)


# ---------------------------------------------------------------- market

_FAIR = """, f0 AS (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a - 1 AS mo0, 1 / close_h + 1 / close_d + 1 / close_a - 1 AS mc0 FROM matches),
f1 AS (SELECT *, CASE WHEN mo0 > 0 THEN mo0 END AS mo, CASE WHEN mc0 > 0 THEN mc0 END AS mc FROM f0),
f AS (SELECT *, 1 / odds_h / (1 + mo) AS oh, 1 / odds_d / (1 + mo) AS od, 1 / odds_a / (1 + mo) AS oa, 1 / close_h / (1 + mc) AS ch, 1 / close_d / (1 + mc) AS cd, 1 / close_a / (1 + mc) AS ca FROM f1)
"""
_OF = {
    "margin_opening": "mo", "margin_closing": "mc", "fair_home_opening": "oh", "fair_draw_opening": "od", "fair_away_opening": "oa",
    "fair_home_closing": "ch", "fair_draw_closing": "cd", "fair_away_closing": "ca", "movement_home": "close_h - odds_h",
    "movement_draw": "close_d - odds_d", "movement_away": "close_a - odds_a", "movement_pct_home": "(close_h - odds_h) / odds_h * 100",
    "movement_pct_away": "(close_a - odds_a) / odds_a * 100", "clv_home": "ch - oh", "clv_draw": "cd - od", "clv_away": "ca - oa",
    "market_confidence": "greatest(ch, cd, ca)",
}


@query(
    "odds_features",
    "7.1 7.3",
    MW
    + _FAIR
    + f"""SELECT match_id, {rsql(_OF)}, CASE WHEN ch = greatest(ch, cd, ca) THEN 'H' WHEN cd = greatest(ch, cd, ca) THEN 'D' WHEN ca = greatest(ch, cd, ca) THEN 'A' END AS market_favorite,
 CASE WHEN ch = least(ch, cd, ca) THEN 'H' WHEN cd = least(ch, cd, ca) THEN 'D' WHEN ca = least(ch, cd, ca) THEN 'A' END AS market_underdog,
 CASE WHEN ch IS NOT NULL THEN CAST(ch = greatest(ch, cd, ca) AS INT) END AS is_home_favorite FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.odds_features(inputs.matches(spark, sf))
    return rounded(out, ["match_id", "market_favorite", "market_underdog", "is_home_favorite"], list(_OF))


_BF = """, q0 AS (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a - 1 AS m0 FROM books), q AS (SELECT *, CASE WHEN m0 > 0 THEN 1 / odds_h / (1 + m0) END AS h,
 CASE WHEN m0 > 0 THEN 1 / odds_d / (1 + m0) END AS d, CASE WHEN m0 > 0 THEN 1 / odds_a / (1 + m0) END AS a FROM q0)
"""


@query(
    "odds_consensus",
    "7.2",
    MB + _BF + "SELECT match_id, count(*) AS bookmakers, round(avg(h), 6) AS consensus_home, round(avg(d), 6) AS consensus_draw, round(avg(a), 6) AS consensus_away FROM q GROUP BY match_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.consensus(inputs.books(spark, sf))
    return rounded(out, ["match_id", "bookmakers"], ["consensus_home", "consensus_draw", "consensus_away"])


@query(
    "odds_volatility",
    "7.4",
    MB + _BF + "SELECT match_id, round((stddev_samp(h) + stddev_samp(d) + stddev_samp(a)) / 3, 6) AS odds_volatility FROM q GROUP BY match_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.volatility(inputs.books(spark, sf)), ["match_id"], ["odds_volatility"])


_BEST = """, b AS (SELECT match_id, max(odds_h) AS h, max(odds_d) AS d, max(odds_a) AS a FROM books GROUP BY match_id)
"""


@query(
    "best_odds",
    "7.5 7.8",
    MB
    + _BEST
    + """SELECT b.match_id, round(h, 6) AS best_h, round(d, 6) AS best_d, round(a, 6) AS best_a, min(bookmaker) FILTER (odds_h = h) AS best_h_bookmaker, min(bookmaker) FILTER (odds_d = d) AS best_d_bookmaker,
 min(bookmaker) FILTER (odds_a = a) AS best_a_bookmaker FROM b JOIN books USING (match_id) GROUP BY b.match_id, h, d, a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.best_odds(inputs.books(spark, sf))
    return rounded(out, ["match_id", "best_h_bookmaker", "best_d_bookmaker", "best_a_bookmaker"], ["best_h", "best_d", "best_a"])


@query(
    "arbitrage_scan",
    "7.6",
    MB
    + _BEST
    + """, i AS (SELECT *, 1 / h + 1 / d + 1 / a AS t FROM b) SELECT match_id, round(t, 6) AS implied_total, round((1 / t - 1) * 100, 6) AS arbitrage_pct, round(100 / h / t, 6) AS stake_h, round(100 / d / t, 6) AS stake_d, round(100 / a / t, 6) AS stake_a FROM i WHERE t < 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.arbitrage(market.best_odds(inputs.books(spark, sf)))
    return rounded(out, ["match_id"], ["implied_total", "arbitrage_pct", "stake_h", "stake_d", "stake_a"])


@query(
    "bookmaker_spreads",
    "7.7",
    MB
    + """SELECT match_id, count(*) AS bookmakers, round(max(odds_h) - min(odds_h), 6) AS spread_h, round(max(odds_d) - min(odds_d), 6) AS spread_d, round(max(odds_a) - min(odds_a), 6) AS spread_a,
 round(greatest(max(odds_h) - min(odds_h), max(odds_d) - min(odds_d), max(odds_a) - min(odds_a)), 6) AS max_disagreement FROM books GROUP BY match_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.bookmaker_spreads(inputs.books(spark, sf))
    return rounded(out, ["match_id", "bookmakers"], ["spread_h", "spread_d", "spread_a", "max_disagreement"])


_CLV = """, k AS (SELECT match_id, bookmaker, quoted_on, 'H' AS outcome, odds_h AS taken, close_h AS closing FROM books UNION ALL SELECT match_id, bookmaker, quoted_on, 'D', odds_d, close_d FROM books
 UNION ALL SELECT match_id, bookmaker, quoted_on, 'A', odds_a, close_a FROM books),
c AS (SELECT *, round(CASE WHEN taken > 1 AND closing > 1 THEN (taken - closing) / closing ELSE 0 END, 6) AS clv FROM k)
"""


def _clv_bets(spark: SparkSession, sf: str) -> DataFrame:
    return market.closing_line_bets(inputs.books(spark, sf))


@query("clv_per_bet", "7.9 7.10 7.12", MB + _CLV + "SELECT match_id, bookmaker, outcome, clv FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _clv_bets(spark, sf).select("match_id", "bookmaker", "outcome", "clv")


@query(
    "clv_measures",
    "7.11 8.41",
    inputs.sql_with("matches", "preds")
    + """SELECT match_id, model, round(1 / close_h - 1 / odds_h, 6) AS implied_shift, round(CASE WHEN p_h > 0 THEN ((1 / close_h) / (1 / close_h + 1 / close_d + 1 / close_a) - p_h) / p_h ELSE 0 END, 6) AS model_clv,
 round((1 / close_h) / (1 / close_h + 1 / close_d + 1 / close_a) - (1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS fair_shift, round((close_h - odds_h) / odds_h, 6) AS live_clv,
 round(p_h - 1 / odds_h, 6) AS edge FROM preds JOIN matches USING (match_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    close = [F.col(f"close_{k}") for k in "hda"]
    opening = [F.col(f"odds_{k}") for k in "hda"]
    out = _preds(spark, sf).select(
        "match_id", "model", O.clv_implied_shift(opening[0], close[0]).alias("implied_shift"),
        O.clv_model(F.col("p_h"), O.fair_probs(close)[0]).alias("model_clv"), O.clv_fair_shift(opening, close)[0].alias("fair_shift"),
        O.clv_live(close[0], opening[0]).alias("live_clv"), O.clv_mean_edge(F.col("p_h"), opening[0]).alias("edge"),
    )
    return rounded(out, ["match_id", "model"], ["implied_shift", "model_clv", "fair_shift", "live_clv", "edge"])


@query(
    "clv_summary",
    "4.20 4.21",
    MB
    + _CLV
    + """SELECT bookmaker, count(*) AS total_bets, count(*) FILTER (closing > 1) AS n_with_closing, count(*) FILTER (closing <= 1) AS n_missing_closing, round(avg(clv), 6) AS avg_clv, round(median(clv), 6) AS median_clv,
 round(stddev_samp(clv), 6) AS std_clv, min(clv) AS min_clv, max(clv) AS max_clv, count(*) FILTER (clv > 0) AS n_positive, count(*) FILTER (clv < 0) AS n_negative, count(*) FILTER (clv = 0) AS n_zero,
 count(*) FILTER (clv > 0.05) AS n_gt_5, count(*) FILTER (clv > 0.1) AS n_gt_10, arg_max(quoted_on, (clv, -epoch(quoted_on))) AS best_date, arg_min(quoted_on, (clv, epoch(quoted_on))) AS worst_date,
 round(count(*) FILTER (clv > 0) / count(*) * 100, 6) AS positive_pct FROM c GROUP BY bookmaker""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.clv_summary(_clv_bets(spark, sf), ["bookmaker"])
    vals = ["avg_clv", "median_clv", "std_clv", "positive_pct"]
    return rounded(out, [c for c in out.columns if c not in vals], vals)


@query("clv_by_month", "4.20", MB + _CLV + "SELECT strftime(quoted_on, '%Y-%m') AS month, count(*) AS n, round(avg(clv), 6) AS avg_clv FROM c GROUP BY month")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.clv_by_month(_clv_bets(spark, sf)), ["month", "n"], ["avg_clv"])


@query(
    "clv_trend",
    "7.13",
    MB
    + _CLV
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY bookmaker ORDER BY quoted_on, match_id, outcome) - 1 AS i, count(*) OVER (PARTITION BY bookmaker) AS n FROM c),
g AS (SELECT bookmaker, max(n) AS n, avg(clv) AS o, avg(clv) FILTER (i < floor(n * 0.4)) AS f, avg(clv) FILTER (i >= n - floor(n * 0.4)) AS l, avg(clv) FILTER (i >= n - greatest(3, least(10, n // 3))) AS r FROM i GROUP BY bookmaker)
SELECT bookmaker, n, round(f, 6) AS first_avg, round(l, 6) AS last_avg, round(r, 6) AS recent_avg, round(CASE WHEN o <> 0 THEN (r - o) / abs(o) * 100 ELSE 0 END, 4) AS recent_vs_overall,
 CASE WHEN n < 5 THEN 'Stable' WHEN l - f > 0.2 * greatest(abs(f), abs(l), 1e-6) THEN 'Improving' WHEN l - f < -0.2 * greatest(abs(f), abs(l), 1e-6) THEN 'Declining' ELSE 'Stable' END AS direction FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = market.clv_trend(_clv_bets(spark, sf), ["bookmaker"], ["quoted_on", "match_id", "outcome"])
    return out.select(
        "bookmaker", "n", *[F.round(c, 6).alias(c) for c in ("first_avg", "last_avg", "recent_avg")], F.round("recent_vs_overall", 4).alias("recent_vs_overall"), "direction"
    )


# ---------------------------------------------------------------- value

_ROWS = """, r AS (SELECT p.match_id, p.model, m.match_date, m.league, m.season, m.result, m.home_goals, m.away_goals, u.outcome, u.place, u.price, u.prob,
 1 / odds_h + 1 / odds_d + 1 / odds_a AS book FROM preds p JOIN matches m USING (match_id),
 LATERAL (SELECT * FROM (VALUES ('H', 0, odds_h, p_h), ('D', 1, odds_d, p_d), ('A', 2, odds_a, p_a)) v(outcome, place, price, prob)) u)
"""
_VT = (
    _ROWS
    + """, v0 AS (SELECT *, 1 / price AS implied, 1 / price / book AS fair, prob * price - 1 AS ev, least(greatest((prob * price - 1) / (price - 1) * 0.25, 0), 0.1) AS k FROM r),
v AS (SELECT *, ev >= 0.02 AND prob > fair AND k > 0 AND price <= 30 AS positive_ev FROM v0)
"""
)


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return bets.value_table(bets.outcome_rows(_preds(spark, sf)))


@query(
    "value_table",
    "8.1 8.2 8.6 8.46",
    MP
    + _VT
    + "SELECT match_id, model, outcome, positive_ev, " + rsql({"price": "price", "implied": "implied", "margin_pct": "(book - 1) * 100", "fair": "fair", "prob": "prob", "ev": "ev", "kelly_pct": "k", "kelly_stake": "1000 * k"}, off_tie=True) + " FROM v",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf).withColumn("margin_pct", F.col("margin") * 100)
    return rounded(t, ["match_id", "model", "outcome", "positive_ev"], ["price", "implied", "margin_pct", "fair", "prob", "ev", "kelly_pct", "kelly_stake"], off_tie=True)


@query(
    "value_bets_best",
    "8.3",
    MP
    + _VT.replace("FROM preds p", "FROM (SELECT * FROM preds WHERE model = 'goals') p")
    + "SELECT match_id, outcome, round(ev, 6) AS ev, positive_ev FROM v QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ev DESC, place) = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf).filter("model = 'goals'").select("match_id", "outcome", "place", "ev", "positive_ev")
    return rounded(bets.best_value_per_match(t), ["match_id", "outcome", "positive_ev"], ["ev"])


@query(
    "value_bets_top",
    "8.45 12.10",
    MP
    + _VT
    + "SELECT match_id, model, outcome, round(ev, 6) AS ev FROM v WHERE positive_ev ORDER BY v.ev DESC, match_id, model, place LIMIT 25",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = bets.value_bets(_table(spark, sf)).orderBy(F.col("ev").desc(), "match_id", "model", "place").limit(25)
    return rounded(t, ["match_id", "model", "outcome"], ["ev"])


@query(
    "kelly_profiles",
    "8.4 8.5 8.10 8.33",
    MP
    + _ROWS
    + """SELECT match_id, model, outcome, profile, round(CASE WHEN prob * price > 1 THEN least((prob * price - 1) / (price - 1), 1) ELSE 0 END * fraction + 1e-10, 6) AS stake_share
FROM r, (VALUES ('conservative', 0.1), ('moderate', 0.25), ('balanced', 0.5), ('aggressive', 0.75), ('max', 1.0)) f(profile, fraction)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = bets.kelly_profiles(bets.outcome_rows(_preds(spark, sf)))
    return rounded(out, ["match_id", "model", "outcome", "profile"], ["stake_share"], off_tie=True)


@query(
    "bet_recommendations",
    "8.29",
    MP
    + _ROWS
    + """, k AS (SELECT *, prob * price - 1 AS ev, CASE WHEN prob * price > 1 THEN least((prob * price - 1) / (price - 1), 1) ELSE 0 END AS k FROM r)
SELECT match_id, model, outcome, round(ev + sign(ev) * 1e-10, 6) AS ev, round(least(k * 0.25, 1) + 1e-10, 6) AS kelly_stake, ev > 0.03 AND prob >= 0.35 AND k > 0 AS recommended FROM k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = bets.recommendations(bets.outcome_rows(_preds(spark, sf)), 0.25, 0.03, 0.35)
    return rounded(out, ["match_id", "model", "outcome", "recommended"], ["ev", "kelly_stake"], off_tie=True)


_STAKE = {
    "flat": "least(10, 800e0)", "percentage": "800e0 * 0.03", "variable_ratio": "CASE WHEN ev >= 0 THEN round(800e0 * least(0.02 * (1 + ev), 0.1) + 1e-9, 2) ELSE 0 END",
    "kelly": "800e0 * CASE WHEN prob * price > 1 THEN least((prob * price - 1) / (price - 1), 1) ELSE 0 END",
    "fractional_kelly": "800e0 * 0.25 * CASE WHEN prob * price > 1 THEN least((prob * price - 1) / (price - 1), 1) ELSE 0 END",
}


@query(
    "stake_rules",
    "8.7 8.30 8.31 8.32 8.33 13.6",
    MP + _ROWS + f", e AS (SELECT *, prob * price - 1 AS ev FROM r) SELECT match_id, model, outcome, {rsql(_STAKE)} FROM e",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = bets.outcome_rows(_preds(spark, sf)).withColumn("ev", F.col("prob") * F.col("price") - 1)
    args = {"flat": (10.0,), "percentage": (0.03,), "variable_ratio": (), "kelly": (), "fractional_kelly": (0.25,)}
    bank = F.lit(800.0)
    out = rows.withColumns({n: bets.STAKES[n](*a)(bank) for n, a in args.items()})
    return rounded(out, ["match_id", "model", "outcome"], list(args))


@query(
    "volatility_stakes",
    "8.8",
    MP
    + """, b AS (SELECT model, match_id, match_date, CASE WHEN result = 'H' THEN odds_h - 1 ELSE -1e0 END AS ret FROM preds JOIN matches USING (match_id) WHERE p_h * odds_h > 1),
w AS (SELECT *, count(ret) OVER x AS n, avg(ret) OVER x AS m, stddev_samp(ret) OVER x AS s FROM b WINDOW x AS (PARTITION BY model ORDER BY match_date, match_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT model, match_id, round(greatest(0.02 / (1 + CASE WHEN n >= 3 AND m <> 0 AND s <> 0 THEN s / greatest(abs(m), 1e-8) ELSE 0 END), 0.005), 6) AS stake_ratio FROM w""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = _preds(spark, sf).filter("p_h * odds_h > 1").withColumn("ret", F.expr("CASE WHEN result = 'H' THEN odds_h - 1 ELSE -1D END"))
    out = bets.volatility_stake(b.select("model", "match_id", "match_date", "ret"), ["model"], bets.ORDER, "ret")
    return rounded(out, ["model", "match_id"], ["stake_ratio"])


@query(
    "portfolio_shares",
    "8.9 8.11",
    MP
    + _VT
    + """, p AS (SELECT *, sum(abs(ev)) OVER w AS te, sum(prob) OVER w AS tp, sum(abs(k)) OVER w AS tk, count(*) OVER w AS n FROM v WHERE positive_ev WINDOW w AS (PARTITION BY model, match_date))
SELECT match_id, model, outcome, round(1 / n, 6) AS share_equal, round(abs(ev) / te, 6) AS share_ev, round(prob / tp, 6) AS share_prob, round(abs(k) / tk, 6) AS share_kelly FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = bets.value_bets(_table(spark, sf)).withColumn("kelly", F.col("kelly_pct"))
    for m in ("equal", "ev", "prob", "kelly"):
        t = bets.portfolio_shares(t, ["model", "match_date"], m).withColumnRenamed("share", f"share_{m}")
    return rounded(t, ["match_id", "model", "outcome"], ["share_equal", "share_ev", "share_prob", "share_kelly"])


_REASON = "CASE WHEN ev < 0.03 THEN 'min_ev' WHEN prob < 0.3 THEN 'min_confidence' WHEN price < 1.5 THEN 'min_odds' WHEN k > 0.08 THEN 'max_stake' WHEN outcome = 'D' THEN 'market' END"


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf).withColumn("stake_pct", F.col("kelly_pct")).withColumn("market", F.when(F.col("outcome") == "D", "DC").otherwise("1X2"))
    return t.withColumn("reason", bets.bet_filter_reason(0.03, 0.3, 1.5, 0.08))


@query("bet_filter", "8.12", MP + _VT + f"SELECT match_id, model, outcome, {_REASON} AS reason FROM v")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf).select("match_id", "model", "outcome", "reason")


@query("bet_rejections", "4.22", MP + _VT + f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM v) q WHERE reason IS NOT NULL GROUP BY reason")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bets.rejection_counts(_filtered(spark, sf))


@query(
    "engine_filters",
    "8.13 8.14",
    MP
    + _VT
    + """, f AS (SELECT *, max(fair) OVER (PARTITION BY match_id, model) AS top FROM v)
SELECT match_id, model, outcome, CASE WHEN ev < 0.01 THEN 'ev' WHEN prob - implied < 0.02 THEN 'edge' WHEN price < 1.6 THEN 'odds_low' WHEN price > 4.0 THEN 'odds_high' WHEN k > 0.05 THEN 'stake' WHEN outcome = 'D' THEN 'outcome' END AS engine_reason,
 CASE WHEN book - 1 > 0.15 THEN 'margin' WHEN top < 0.4 THEN 'confidence' END AS market_reason FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf).withColumns({"edge": F.col("prob") - F.col("implied"), "stake_pct": F.col("kelly_pct")})
    fair = O.fair_probs([F.col(f"odds_{k}") for k in "hda"])
    t = t.withColumns({f"fair_{k}": f for k, f in zip("hda", fair, strict=True)})
    engine = bets.engine_filter_reason(0.01, 0.02, 1.6, 4.0, 0.05, ("H", "A"))
    return t.select("match_id", "model", "outcome", engine.alias("engine_reason"), bets.market_filter_reason(0.15, 0.4).alias("market_reason"))


@query(
    "settlement",
    "8.16",
    MW
    + """SELECT match_id, market, pick, line, CASE WHEN market = 'OU' AND line = floor(line) AND home_goals + away_goals = line THEN 'push'
 WHEN (market = '1X2' AND pick = result) OR (market = 'BTTS' AND (pick = 'yes') = (home_goals > 0 AND away_goals > 0)) OR (market = 'OU' AND pick = 'over' AND home_goals + away_goals > line)
  OR (market = 'OU' AND pick = 'under' AND home_goals + away_goals < line) THEN 'won' ELSE 'lost' END AS status
FROM matches, (VALUES ('1X2', 'H', 2.5e0), ('1X2', 'D', 2.5e0), ('1X2', 'A', 2.5e0), ('BTTS', 'yes', 2.5e0), ('BTTS', 'no', 2.5e0), ('OU', 'over', 2.5e0), ('OU', 'under', 3e0), ('OU', 'over', 3e0)) b(market, pick, line)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    picks = [("1X2", "H", 2.5), ("1X2", "D", 2.5), ("1X2", "A", 2.5), ("BTTS", "yes", 2.5), ("BTTS", "no", 2.5), ("OU", "over", 2.5), ("OU", "under", 3.0), ("OU", "over", 3.0)]
    b = F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.lit(o).alias("pick"), F.lit(x).alias("line")) for m, o, x in picks]))
    out = inputs.matches(spark, sf).select("match_id", "home_goals", "away_goals", b.alias("b")).select("match_id", "home_goals", "away_goals", "b.*")
    status = bets.settle(F.col("market"), F.col("pick"), F.col("home_goals"), F.col("away_goals"), F.col("line"))
    return out.select("match_id", "market", "pick", "line", status.alias("status"))


# ---------------------------------------------------------------- backtests

_RULES = bets.BetRules(min_ev=0.05, min_confidence=0.25, min_odds=1.5, max_odds=6.0)
_ONE = (
    _ROWS
    + """, b0 AS (SELECT *, prob * price - 1 AS ev FROM r WHERE price > 1 AND prob * price - 1 >= 0.05 AND prob >= 0.25 AND price >= 1.5 AND price <= 6 QUALIFY row_number() OVER (PARTITION BY match_id, model ORDER BY place) = 1),
b1 AS (SELECT b0.*, m.status = 'playing' AS void FROM b0 JOIN (SELECT match_id, status FROM matches) m USING (match_id)),
b AS (SELECT *, CASE WHEN void THEN 'push' WHEN outcome = result THEN 'won' ELSE 'lost' END AS st, CASE WHEN void THEN 0e0 WHEN outcome = result THEN price - 1 ELSE -1e0 END AS ret FROM b1)
"""
)


def _one(spark: SparkSession, sf: str) -> DataFrame:
    picked = bets.one_bet_per_match(_preds(spark, sf).withColumnRenamed("status", "state"), _RULES)
    return bets.with_return(picked, F.col("state") == "playing")


_K = "least(CASE WHEN prob * price > 1 THEN least((prob * price - 1) / (price - 1), 1) ELSE 0 END * 0.25, 0.1)"
_COMP = (
    _ONE
    + f""", s AS (SELECT *, {_K} AS share FROM b), l AS (SELECT *, coalesce(sum(ln(1 + share * ret)) OVER (PARTITION BY model ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lg FROM s),
c AS (SELECT *, 1000 * exp(lg) AS bb, 1000 * exp(lg) * share AS stake, 1000 * exp(lg) * share * ret AS profit, 1000 * exp(lg) * (1 + share * ret) AS ba FROM l),
e AS (SELECT *, greatest(1000, max(ba) OVER (PARTITION BY model ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
"""
)


def _kelly_share() -> F.Column:
    return F.least(O.kelly(F.col("prob"), F.col("price")) * 0.25, F.lit(0.1))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    settled = bets.compound(_one(spark, sf), ["model"], _kelly_share())
    return bets.equity_curve(settled, ["model"])


@query(
    "backtest_kelly",
    "8.17 8.18 8.19 8.20",
    MP + _COMP + "SELECT match_id, model, outcome, st AS status, " + rsql({"bankroll_before_rel": "ln(bb)", "stake_rel": "stake / bb", "bankroll_after_rel": "ln(ba)", "drawdown_pct": "(peak - ba) / peak * 100"}, 5, off_tie=True) + " FROM e",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = _curve(spark, sf).withColumns(
        {"bankroll_before_rel": F.log("bankroll_before"), "stake_rel": F.col("stake") / F.col("bankroll_before"), "bankroll_after_rel": F.log("bankroll_after")}
    )
    return rounded(out, ["match_id", "model", "outcome", "status"], ["bankroll_before_rel", "stake_rel", "bankroll_after_rel", "drawdown_pct"], 5, off_tie=True)


@query(
    "backtest_metrics",
    "8.21 8.22 8.20",
    MP
    + _COMP
    + """, a AS (SELECT *, CASE WHEN st <> 'push' THEN profit / bb END AS r1 FROM e)
SELECT model, count(*) FILTER (st <> 'push') AS total_bets, count(*) FILTER (st = 'won') AS winning_bets, count(*) FILTER (st = 'push') AS pushed_bets, """
    + rsql(
        {
            "avg_odds": "avg(price) FILTER (st <> 'push')", "roi": "sum(profit) / sum(stake) FILTER (st <> 'push')",
            "win_rate": "count(*) FILTER (st = 'won') / count(*) FILTER (st <> 'push')", "profit_factor": "sum(stake + profit) FILTER (st = 'won') / sum(stake) FILTER (st <> 'push')",
            "max_drawdown_pct": "max((peak - ba) / peak * 100)", "sharpe_ratio": "avg(r1) / stddev_samp(r1) * sqrt(500)", "sortino_ratio": "avg(r1) / stddev_samp(r1) FILTER (r1 < 0) * sqrt(500)",
            "log_final": "ln(1000 + sum(profit))",
        }
    )
    + " FROM a GROUP BY model",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = bets.metrics(_curve(spark, sf), ["model"]).withColumn("log_final", F.log("final_bankroll"))
    return rounded(
        out, ["model", "total_bets", "winning_bets", "pushed_bets"],
        ["avg_odds", "roi", "win_rate", "profit_factor", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "log_final"],
    )


@query(
    "backtest_flat",
    "8.17 8.30",
    MP
    + _ONE
    + """, f AS (SELECT *, 100000 + coalesce(10 * sum(ret) OVER (PARTITION BY model ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bb FROM b)
SELECT match_id, model, round(bb, 4) AS bankroll_before, round(bb + 10 * ret, 4) AS bankroll_after FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = bets.flat_backtest(_one(spark, sf), ["model"], 10.0, 100_000.0)
    return rounded(out, ["match_id", "model"], ["bankroll_before", "bankroll_after"], 4)


@query(
    "backtest_streaks",
    "8.23",
    MP
    + _ONE
    + """, a AS (SELECT model, match_date, match_id, CAST(st = 'won' AS INT) AS w FROM b WHERE st <> 'push'),
g AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY match_date, match_id) - row_number() OVER (PARTITION BY model, w ORDER BY match_date, match_id) AS isl FROM a),
u AS (SELECT model, w, isl, count(*) AS n, max((match_date, match_id)) AS last FROM g GROUP BY ALL), t AS (SELECT model, max((match_date, match_id)) AS last FROM a GROUP BY model)
SELECT u.model, coalesce(max(n) FILTER (w = 1), 0) AS longest_win, coalesce(max(n) FILTER (w = 0), 0) AS longest_lose, coalesce(max(n) FILTER (w = 1 AND u.last = t.last), 0) AS current_win,
 coalesce(max(n) FILTER (w = 0 AND u.last = t.last), 0) AS current_lose FROM u JOIN t ON t.model = u.model GROUP BY u.model""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bets.streaks(_one(spark, sf), ["model"])


@query(
    "backtest_breakdown",
    "4.19 8.26",
    MP
    + _ONE
    + """SELECT model, league, season, count(*) AS bets, count(*) FILTER (st = 'won') AS wins, round(sum(ret), 6) AS profit, round(sum(ret) / count(*) * 100, 6) AS yield_pct
FROM b GROUP BY GROUPING SETS ((model), (model, league), (model, season)) HAVING count(*) >= 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = bets.breakdown(_one(spark, sf), [["model"], ["model", "league"], ["model", "season"]], min_bets=5)
    return rounded(out, ["model", "league", "season", "bets", "wins"], ["profit", "yield_pct"])


_EVS = [0.0, 0.02, 0.05, 0.10, 0.15, 0.20]
_FRAC = [0.10, 0.25, 0.50, 1.0]
_SCAN = (
    _ROWS
    + f""", g AS (SELECT r.*, e.min_ev, f.kelly_frac FROM r, (SELECT unnest([{', '.join(f'{v}e0' for v in _EVS)}]) AS min_ev) e, (SELECT unnest([{', '.join(f'{v}e0' for v in _FRAC)}]) AS kelly_frac) f),
p AS (SELECT *, CASE WHEN outcome = result THEN price - 1 ELSE -1e0 END AS ret, least(CASE WHEN prob * price > 1 THEN least((prob * price - 1) / (price - 1), 1) ELSE 0 END * kelly_frac, 0.1) AS share
 FROM g WHERE prob * price - 1 >= min_ev QUALIFY row_number() OVER (PARTITION BY match_id, model, min_ev, kelly_frac ORDER BY place) = 1),
l AS (SELECT *, coalesce(sum(ln(1 + share * ret)) OVER (PARTITION BY model, min_ev, kelly_frac ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lg FROM p),
c AS (SELECT *, 1000 * exp(lg) * share AS stake, 1000 * exp(lg) * share * ret AS profit, 1000 * exp(lg) * (1 + share * ret) AS ba FROM l),
e AS (SELECT *, greatest(1000, max(ba) OVER (PARTITION BY model, min_ev, kelly_frac ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
m AS (SELECT model, min_ev, kelly_frac, count(*) AS total_bets, sum(profit) AS profit, sum(stake) AS staked, max((peak - ba) / peak * 100) AS dd FROM e GROUP BY ALL)
"""
)


@query(
    "parameter_scan",
    "8.24 8.25",
    MP + _SCAN + "SELECT model, min_ev, kelly_frac, total_bets, round(ln(1000 + profit), 6) AS log_final, round(profit / staked, 6) AS roi, round(dd, 6) AS max_drawdown_pct FROM m",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = bets.parameter_scan(_preds(spark, sf), _EVS, _FRAC, ["model"]).withColumn("log_final", F.log("final_bankroll"))
    return rounded(out, ["model", "min_ev", "kelly_frac", "total_bets"], ["log_final", "roi", "max_drawdown_pct"])


@query(
    "parameter_pick",
    "8.24",
    MP
    + _SCAN
    + """SELECT model, arg_max(min_ev, (round(1000 + profit, 6), -min_ev, -kelly_frac)) AS profit_ev, arg_max(kelly_frac, (round(1000 + profit, 6), -min_ev, -kelly_frac)) AS profit_kelly,
 arg_max(min_ev, (round(profit / staked * 100, 6), -min_ev, -kelly_frac)) FILTER (total_bets >= 20) AS yield_ev, arg_max(kelly_frac, (round(profit / staked * 100, 6), -min_ev, -kelly_frac)) FILTER (total_bets >= 20) AS yield_kelly,
 arg_max(min_ev, (round(CASE WHEN total_bets >= 10 THEN profit / staked * 100 / greatest(dd, 0.1) ELSE 0 END, 6), -min_ev, -kelly_frac)) AS safe_ev,
 arg_max(kelly_frac, (round(CASE WHEN total_bets >= 10 THEN profit / staked * 100 / greatest(dd, 0.1) ELSE 0 END, 6), -min_ev, -kelly_frac)) AS safe_kelly FROM m GROUP BY model""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = bets.pick_parameters(bets.parameter_scan(_preds(spark, sf), _EVS, _FRAC, ["model"]), ["model"])
    names = {"profit": "best_profit", "yield": "best_yield", "safe": "safest"}
    return best.select("model", *[F.col(f"{c}.{f}").alias(f"{n}_{s}") for n, c in names.items() for f, s in (("min_ev", "ev"), ("kelly_frac", "kelly"))])


@query(
    "threshold_roi",
    "8.40",
    MP
    + _ROWS
    + "SELECT model, count(*) AS bets, count(*) FILTER (outcome = result) AS wins, round(sum(CASE WHEN outcome = result THEN price - 1 ELSE -1 END), 6) AS profit, round(sum(CASE WHEN outcome = result THEN price - 1 ELSE -1 END) / count(*), 6) AS roi FROM r WHERE prob > 1 / price AND prob > 0.4 GROUP BY model",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bets.threshold_roi(bets.outcome_rows(_preds(spark, sf)), ["model"]), ["model", "bets", "wins"], ["profit", "roi"])


@query("mean_edge", "8.41", MP + _ROWS + "SELECT model, round(avg(prob - 1 / price), 9) AS mean_edge FROM r GROUP BY model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bets.mean_edge(bets.outcome_rows(_preds(spark, sf)), ["model"]), ["model"], ["mean_edge"], 9)


# Strategies: one model, league choice and share of the bankroll each; bets are replayed per strategy.
_STRATEGIES = [("home_value", "ensemble", None, 0.4), ("goals_europe", "goals", "EUROPE", 0.2), ("market_follow", "market", None, 0.1), ("goals_all", "goals", None, 0.3)]


@query(
    "strategy_portfolio",
    "8.27 8.28 8.44",
    MP
    + _ONE
    + """, s AS (SELECT b.*, k.strategy, k.allocation FROM b JOIN (VALUES ('home_value', 'ensemble', NULL, 0.4e0), ('goals_europe', 'goals', 'EUROPE', 0.2e0), ('market_follow', 'market', NULL, 0.1e0), ('goals_all', 'goals', NULL, 0.3e0)) k(strategy, model, lg, allocation)
 ON k.model = b.model AND (k.lg IS NULL OR k.lg = b.league))
SELECT strategy, count(*) FILTER (st <> 'push') AS total_bets, count(*) FILTER (st = 'won') AS winning_bets, round(sum(ret) * 10 * max(allocation), 6) AS profit, round(sum(ret) / count(*) FILTER (st <> 'push'), 6) AS roi FROM s GROUP BY strategy""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(m).alias("m"), F.lit(lg).cast("string").alias("lg"), F.lit(a).alias("allocation")) for s, m, lg, a in _STRATEGIES])
    b = _one(spark, sf)
    mine = F.filter(rows, lambda s: (s["m"] == F.col("model")) & (s["lg"].isNull() | (s["lg"] == F.col("league"))))
    out = b.withColumn("_s", F.explode(mine)).select("*", "_s.strategy", "_s.allocation").drop("_s")
    active = F.count_if(F.col("status") != "push")
    out = out.groupBy("strategy").agg(
        active.alias("total_bets"), F.count_if(F.col("status") == "won").alias("winning_bets"),
        (F.sum("unit_return") * 10 * F.max("allocation")).alias("profit"), (F.sum("unit_return") / active).alias("roi"),
    )
    return rounded(out, ["strategy", "total_bets", "winning_bets"], ["profit", "roi"])


@query(
    "value_replay_raw_vs_calibrated",
    "8.42 8.43",
    MP
    + """, v AS (SELECT 'raw' AS variant, match_id, p_h, p_d, p_a FROM preds WHERE model = 'goals' UNION ALL
 SELECT 'calibrated', match_id, pow(p_h, 0.7) / s, pow(p_d, 0.7) / s, pow(p_a, 0.7) / s FROM (SELECT *, pow(p_h, 0.7) + pow(p_d, 0.7) + pow(p_a, 0.7) AS s FROM preds WHERE model = 'goals') q),
u AS (SELECT variant, o.price, o.prob, o.outcome = result AS won FROM v JOIN matches USING (match_id), LATERAL (SELECT * FROM (VALUES ('H', odds_h, p_h), ('D', odds_d, p_d), ('A', odds_a, p_a)) t(outcome, price, prob)) o)
SELECT variant, count(*) AS bets, count(*) FILTER (won) AS wins, round(sum(CASE WHEN won THEN price - 1 ELSE -1 END), 6) AS profit FROM u WHERE prob * price - 1 >= 0.05 GROUP BY variant""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = _preds(spark, sf).filter("model = 'goals'")
    s = "(pow(p_h, 0.7D) + pow(p_d, 0.7D) + pow(p_a, 0.7D))"
    both = F.explode(
        F.array(
            F.struct(F.lit("raw").alias("variant"), "p_h", "p_d", "p_a"),
            F.struct(F.lit("calibrated").alias("variant"), *[F.expr(f"pow(p_{k}, 0.7D) / {s}").alias(f"p_{k}") for k in "hda"]),
        )
    )
    rows = bets.outcome_rows(p.drop("model").withColumn("_v", both).drop("p_h", "p_d", "p_a").select("*", "_v.*").drop("_v"))
    won = F.col("outcome") == F.col("result")
    out = rows.filter("prob * price - 1 >= 0.05").groupBy("variant").agg(
        F.count("*").alias("bets"), F.count_if(won).alias("wins"), F.sum(F.when(won, F.col("price") - 1).otherwise(-1.0)).alias("profit")
    )
    return rounded(out, ["variant", "bets", "wins"], ["profit"])


# ---------------------------------------------------------------- risk: one event is one bet of the user's account

_BET = {
    "account": "user_id", "bet_id": "event_id", "ts": "ts", "stake": "10e0 + event_id % 40", "bankroll_before": "1000e0 + event_id % 300",
    "unit_return": "CASE WHEN event_type = 'purchase' THEN 2.5e0 ELSE -1e0 END", "won": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
    "profit": "(10e0 + event_id % 40) * CASE WHEN event_type = 'purchase' THEN 2.5e0 ELSE -1e0 END", "price": "1.2e0 + (event_id % 300) / 10e0",
    "league": "event_type", "stake_share": "0.01e0 + (event_id % 30) / 100e0",
}
_BETS_SQL = "WITH b AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BET.items()) + " FROM events)\n"


def _bets(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in _BET.items()])


_W = "(PARTITION BY account ORDER BY ts, bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "risk_daily_loss",
    "8.34 12.6",
    _BETS_SQL
    + """SELECT account, bet_id, round(coalesce(sum(greatest(-profit, 0)) OVER w, 0) / first_value(bankroll_before) OVER d * 100, 6) AS daily_loss_pct FROM b
WINDOW d AS (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, bet_id), w AS (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(risk.daily_loss(_bets(spark, sf)), ["account", "bet_id"], ["daily_loss_pct"])


@query(
    "risk_drawdown",
    "8.35",
    _BETS_SQL
    + f"SELECT account, bet_id, round((greatest(max(bankroll_before) OVER {_W}, bankroll_before) - bankroll_before) / greatest(max(bankroll_before) OVER {_W}, bankroll_before) * 100, 6) AS drawdown_pct FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(risk.drawdown_limit(_bets(spark, sf)), ["account", "bet_id"], ["drawdown_pct"])


@query(
    "risk_loss_streak",
    "8.36",
    _BETS_SQL
    + f""", i AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, bet_id) - 1 AS i FROM b)
SELECT account, bet_id, i - coalesce(max(CASE WHEN won = 1 THEN i + 1 END) OVER {_W}, 0) AS losses_in_row, i - coalesce(max(CASE WHEN won = 1 THEN i + 1 END) OVER {_W}, 0) >= 6 AS blocked FROM i""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return risk.loss_streak(_bets(spark, sf)).select("account", "bet_id", "losses_in_row", "blocked")


@query(
    "risk_frequency",
    "12.5 8.15",
    _BETS_SQL
    + """, s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY account, sec ORDER BY ts, bet_id) AS rn, count(*) OVER (PARTITION BY account, sec) AS same FROM s)
SELECT account, bet_id, count(*) OVER (PARTITION BY account ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) - same + rn - 1 AS bets_last_hour,
 row_number() OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, bet_id) - 1 AS bets_today, row_number() OVER (PARTITION BY account, date_trunc('week', ts) ORDER BY ts, bet_id) - 1 AS bets_this_week FROM n""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return risk.frequency(_bets(spark, sf)).select("account", "bet_id", "bets_last_hour", "bets_today", "bets_this_week")


@query(
    "risk_stake_limits",
    "8.37",
    _BETS_SQL
    + "SELECT bet_id, CASE WHEN stake / bankroll_before * 100 > 4 THEN 'stake' WHEN price < 1.5 THEN 'odds_low' WHEN price > 20 THEN 'odds_high' WHEN league IN ('error') THEN 'league_excluded' END AS reason FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _bets(spark, sf).select("bet_id", risk.stake_limits(4.0, excluded=("error",)).alias("reason"))


@query(
    "risk_diversification",
    "8.38",
    _BETS_SQL
    + "SELECT bet_id, round(sum(stake) OVER (PARTITION BY account, league ORDER BY ts, bet_id ROWS UNBOUNDED PRECEDING) / bankroll_before * 100, 6) AS exposure_pct FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(risk.group_exposure(_bets(spark, sf), "league"), ["bet_id"], ["exposure_pct"])


@query(
    "risk_open_exposure",
    "8.39",
    _BETS_SQL
    + """, e AS (SELECT account, ts AS tt, 1 AS step, stake AS amount, bet_id FROM b UNION ALL SELECT account, ts + INTERVAL 6 HOUR, -1, -stake, bet_id FROM b),
w AS (SELECT *, coalesce(sum(step) OVER x, 0) AS n, coalesce(sum(amount) OVER x, 0) AS s FROM e WINDOW x AS (PARTITION BY account ORDER BY tt, step, bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT bet_id, CAST(n AS BIGINT) AS open_bets, round(s, 4) AS open_stake FROM w WHERE step = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = _bets(spark, sf).withColumn("settled_ts", F.expr("ts + INTERVAL 6 HOURS"))
    return rounded(risk.open_exposure(b), ["bet_id", "open_bets"], ["open_stake"], 4)


@query("risk_gated_bets", "8.15 13.4")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return risk.gated_bets(_bets(spark, sf), risk.RiskLimits())
