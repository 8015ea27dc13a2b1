"""Evaluation, calibration, blending, training and feature selection."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import aggregates, evaluation as ev, form, learning, tuning
from touchline.operators.boosting import BoostingParams, fit_boosted
from touchline.plans import inputs
from touchline.plans.common import rounded, rsql
from touchline.plans.registry import query
from touchline.sources.shared import written

MW = inputs.sql_with("matches")
MP = inputs.sql_with("matches", "preds")
_J = MP + ", j AS (SELECT p.*, m.result, m.league, m.season, m.home_goals, m.away_goals FROM preds p JOIN matches m USING (match_id))\n"
_KEEP = ("result", "league", "season", "home_goals", "away_goals")


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.preds(spark, sf, _KEEP)


_PICK = "CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END"
_BRIER = "pow(CAST(result = 'H' AS INT) - p_h, 2) + pow(CAST(result = 'D' AS INT) - p_d, 2) + pow(CAST(result = 'A' AS INT) - p_a, 2)"
_LL = "-ln(greatest(CASE result WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END, 1e-15))"
_METRICS = {"accuracy": f"avg(CAST({_PICK} = result AS INT))", "brier": f"avg({_BRIER})", "log_loss": f"avg({_LL})"}


@query("outcome_metrics", "9.10 9.37 9.21", _J + f"SELECT model, league, count(*) AS n, {rsql(_METRICS)} FROM j GROUP BY model, league")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.outcome_metrics(_preds(spark, sf), ["model", "league"]), ["model", "league", "n"], list(_METRICS))


_BIN = {
    "accuracy": "avg(CAST((p >= 0.5) = (y = 1) AS INT))", "precision": "coalesce(sum(CAST(p >= 0.5 AS INT) * y) / nullif(sum(CAST(p >= 0.5 AS INT)), 0), 0)",
    "recall": "coalesce(sum(CAST(p >= 0.5 AS INT) * y) / nullif(sum(y), 0), 0)", "f1": "coalesce(2 * sum(CAST(p >= 0.5 AS INT) * y) / nullif(sum(CAST(p >= 0.5 AS INT)) + sum(y), 0), 0)",
    "brier": "avg(pow(p - y, 2))", "log_loss": "avg(-(y * ln(p) + (1 - y) * ln(1 - p)))",
}


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return _preds(spark, sf).withColumns({"p": F.col("p_h"), "y": (F.col("result") == "H").cast("int")})


@query("binary_metrics", "9.10 9.11", _J + f", b AS (SELECT model, p_h AS p, CAST(result = 'H' AS INT) AS y FROM j) SELECT model, count(*) AS n, {rsql(_BIN)} FROM b GROUP BY model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.binary_metrics(_binary(spark, sf), "p", "y", ["model"]), ["model", "n"], list(_BIN))


@query("confusion_counts", "9.11", _J + f"SELECT model, result, {_PICK} AS predicted, count(*) AS n FROM j GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(_preds(spark, sf), ["model"])


@query(
    "roc_auc",
    "9.11",
    _J
    + """, b AS (SELECT model, round(p_h, 6) AS p, CAST(result = 'H' AS INT) AS y FROM j), c AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY ALL),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT model, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY model""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.roc_auc(_binary(spark, sf), "p", "y", ["model"]), ["model"], ["auc"])


_REL = ", b AS (SELECT model, p_h AS p, CAST(result = 'H' AS INT) AS y, CAST(least(floor(p_h * 10), 9) AS INT) AS bin FROM j), r AS (SELECT model, bin, count(*) AS n, avg(p) AS mean_prob, avg(y) AS hit_rate FROM b GROUP BY ALL)\n"


@query("reliability_bins", "9.12 9.13", _J + _REL + "SELECT model, bin, n, round(mean_prob, 6) AS mean_prob, round(hit_rate, 6) AS hit_rate FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.reliability(_binary(spark, sf), "p", "y", ["model"]), ["model", "bin", "n"], ["mean_prob", "hit_rate"])


@query("calibration_error", "9.12", _J + _REL + "SELECT model, round(sum(n * abs(mean_prob - hit_rate)) / sum(n), 6) AS ece, round(max(abs(mean_prob - hit_rate)), 6) AS mce FROM r GROUP BY model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.calibration_error(ev.reliability(_binary(spark, sf), "p", "y", ["model"]), ["model"]), ["model"], ["ece", "mce"])


@query(
    "reliability_per_class",
    "9.33",
    _J
    + """, c AS (SELECT model, 'H' AS class, p_h AS p, CAST(result = 'H' AS INT) AS y FROM j UNION ALL SELECT model, 'D', p_d, CAST(result = 'D' AS INT) FROM j UNION ALL SELECT model, 'A', p_a, CAST(result = 'A' AS INT) FROM j)
SELECT model, class, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_prob, round(avg(y), 6) AS hit_rate FROM c GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.one_vs_rest(_preds(spark, sf), ["model"])
    return rounded(ev.reliability(rows, "prob", "hit", ["model", "class"]), ["model", "class", "bin", "n"], ["mean_prob", "hit_rate"])


@query(
    "prediction_entropy",
    "2.47 2.37 2.38",
    _J
    + """, s AS (SELECT model, p_h, p_d, p_a, exp(p_h) / (exp(p_h) + exp(p_d) + exp(p_a)) AS soft_h, (p_h * 0.8) / (p_h * 0.8 + p_d + p_a) AS renorm_h FROM j)
SELECT model, round(avg(-(p_h * ln(p_h) + p_d * ln(p_d) + p_a * ln(p_a))), 6) AS entropy, round(avg(soft_h), 6) AS soft_h, round(avg(renorm_h), 6) AS renorm_h FROM s GROUP BY model""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = _preds(spark, sf)
    cols = [F.col(f"p_{k}") for k in "hda"]
    p = p.withColumns({"e": ev.entropy(cols), "s": ev.softmax(cols)[0], "x": F.col("p_h") * 0.8, "y": F.col("p_d"), "z": F.col("p_a")})
    out = ev.renormalise(p, ["x", "y", "z"]).groupBy("model").agg(F.avg("e").alias("entropy"), F.avg("s").alias("soft_h"), F.avg("x").alias("renorm_h"))
    return rounded(out, ["model"], ["entropy", "soft_h", "renorm_h"])


@query(
    "confidence_scores",
    "9.14",
    _J
    + """, a AS (SELECT match_id, avg(p_h) h, avg(p_d) d, avg(p_a) a, (stddev_samp(p_h) + stddev_samp(p_d) + stddev_samp(p_a)) / 3 s FROM j GROUP BY match_id)
SELECT match_id, round(least(greatest(0.4 * (1 + (h * ln(h) + d * ln(d) + a * ln(a)) / ln(3)) + 0.35 * greatest(1 - s / 0.5, 0) + 0.25 * 0.7, 0), 1), 6) AS confidence FROM a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.confidence(_preds(spark, sf), ["match_id"], 0.6), ["match_id"], ["confidence"])


_W = {"ensemble": 0.5, "goals": 0.3, "market": 0.2}
_BLEND = ", b AS (SELECT match_id, result, " + ", ".join(
    f"sum(p_{k} * CASE model WHEN 'ensemble' THEN 0.5e0 WHEN 'goals' THEN 0.3e0 ELSE 0.2e0 END) AS p_{k}" for k in "hda"
) + " FROM j GROUP BY match_id, result)\n"


@query("blend_weighted", "9.1", _J + _BLEND + "SELECT match_id, round(p_h, 6) AS p_h, round(p_d, 6) AS p_d, round(p_a, 6) AS p_a FROM b")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.blend(_preds(spark, sf), _W), ["match_id"], ["p_h", "p_d", "p_a"])


@query(
    "blend_override",
    "9.2",
    inputs.sql_with("matches", "preds")
    + """, x AS (SELECT match_id, p_h, p_a, p_d * CASE WHEN abs((home_shots - away_shots) * 30) < 50 THEN 1.1 WHEN abs((home_shots - away_shots) * 30) > 200 THEN 0.9 ELSE 1 END AS p_d FROM preds JOIN matches USING (match_id) WHERE model = 'market')
SELECT match_id, round(p_h / (p_h + p_d + p_a), 6) AS p_h, round(p_d / (p_h + p_d + p_a), 6) AS p_d, round(p_a / (p_h + p_d + p_a), 6) AS p_a FROM x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.preds(spark, sf, ("home_shots", "away_shots")).filter("model = 'market'")
    return rounded(ev.override_draws(p, (F.col("home_shots") - F.col("away_shots")) * 30), ["match_id"], ["p_h", "p_d", "p_a"])


_GRID = ev.weight_grid(["ensemble", "goals", "market"], 0.1)
_WIDE = ", w AS (SELECT league, match_id, result, " + ", ".join(
    f"max(p_{k}) FILTER (model = '{m}') AS {m}_{k}" for m in _W for k in "hda"
) + " FROM j GROUP BY ALL), g AS (SELECT e / 10e0 AS ensemble, o / 10e0 AS goals, (10 - e - o) / 10e0 AS market FROM (SELECT unnest(range(0, 11)) e) a, (SELECT unnest(range(0, 11)) o) b WHERE e + o <= 10)\n"


def _mix(k: str) -> str:
    return f"(ensemble * ensemble_{k} + goals * goals_{k} + market * market_{k})"


_MIX_LL = f"-ln(greatest(CASE result WHEN 'H' THEN {_mix('h')} WHEN 'D' THEN {_mix('d')} ELSE {_mix('a')} END, 1e-15))"
_MIX_BRIER = " + ".join(f"pow(CAST(result = '{k.upper()}' AS INT) - {_mix(k)}, 2)" for k in "hda")


@query(
    "blend_weight_search",
    "9.3 9.4 9.22",
    _J + _WIDE + f"SELECT round(ensemble, 6) AS ensemble, round(goals, 6) AS goals, round(market, 6) AS market, round(avg({_MIX_LL}), 6) AS loss FROM w, g GROUP BY ensemble, goals, market",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.search_weights(_preds(spark, sf), _GRID, [])
    return rounded(out, [], ["ensemble", "goals", "market", "loss"])


@query(
    "blend_best_per_league",
    "9.3 9.23 9.24",
    _J
    + _WIDE
    + f""", s AS (SELECT league, ensemble, goals, market, avg({_MIX_BRIER}) AS loss FROM w, g WHERE least(ensemble, goals, market) >= 0.1 AND greatest(ensemble, goals, market) <= 0.7 GROUP BY ALL)
SELECT league, round(ensemble, 6) AS ensemble, round(goals, 6) AS goals, round(market, 6) AS market, round(loss, 6) AS loss FROM s QUALIFY row_number() OVER (PARTITION BY league ORDER BY round(loss, 9), ensemble, goals) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    grid = ev.weight_grid(["ensemble", "goals", "market"], 0.1, 0.1, 0.7)
    out = ev.best_weights(ev.search_weights(_preds(spark, sf), grid, ["league"], "brier"), ["league"])
    return rounded(out, ["league"], ["ensemble", "goals", "market", "loss"])


def _calibration(spark: SparkSession, sf: str, method: str) -> DataFrame:
    """Losses of every model before and after calibration on the seasons before 1999, of the later ones."""
    p = _preds(spark, sf)
    train, test = p.filter("season < 1999"), p.filter("season >= 1999")
    both = test.withColumn("variant", F.lit("raw")).unionByName(ev.calibrate(train, test, method, ("model",)).withColumn("variant", F.lit(method)))
    return rounded(ev.outcome_metrics(both, ["model", "variant"]), ["model", "variant", "n"], ["accuracy", "brier", "log_loss"], 4)


def _long(where: str) -> str:
    return " UNION ALL ".join(f"SELECT match_id, model, result, '{k.upper()}' AS class, p_{k} AS p, CAST(result = '{k.upper()}' AS INT) AS y FROM j WHERE {where}" for k in "hda")


_CAL = _J.replace("WITH ", "WITH RECURSIVE ", 1) + f", tr AS ({_long('season < 1999')}), te AS ({_long('season >= 1999')})\n"
#: The monotone curve as the lower hull of running sums: from each corner on to the point of least slope, the farthest of equal ones.
_ISO = """, d AS (SELECT model, class, p, sum(y) AS s, count(*) AS w FROM tr GROUP BY ALL),
c AS (SELECT model, class, p, CAST(sum(s) OVER o AS BIGINT) AS cs, CAST(sum(w) OVER o AS BIGINT) AS cw, row_number() OVER o AS i FROM d WINDOW o AS (PARTITION BY model, class ORDER BY p)),
hull AS (SELECT DISTINCT model, class, {'v': CAST(0 AS DOUBLE), 'i': CAST(0 AS BIGINT), 'cs': CAST(0 AS BIGINT), 'cw': CAST(0 AS BIGINT)} AS x FROM d
UNION ALL SELECT h.model, h.class, min({'v': (c.cs - h.x.cs) / (c.cw - h.x.cw), 'i': -c.i, 'cs': c.cs, 'cw': c.cw}) FROM hull h JOIN c ON c.model = h.model AND c.class = h.class AND c.i > -h.x.i GROUP BY h.model, h.class),
k AS (SELECT model, class, x.v AS v, -x.i AS i, lag(-x.i) OVER (PARTITION BY model, class ORDER BY -x.i) AS before FROM hull),
g AS (SELECT k.model, k.class, k.v, f.p AS lo, l.p AS hi FROM k JOIN c f ON f.model = k.model AND f.class = k.class AND f.i = k.before + 1 JOIN c l ON l.model = k.model AND l.class = k.class AND l.i = k.i),
e AS (SELECT *, lead(lo) OVER o AS nx, lead(v) OVER o AS nv, CASE WHEN lag(lo) OVER o IS NULL THEN -1 ELSE lo END AS start FROM g WINDOW o AS (PARTITION BY model, class ORDER BY lo)),
iso AS (SELECT te.*, CASE WHEN te.p <= e.hi OR e.nx IS NULL THEN e.v ELSE e.v + (e.nv - e.v) * (te.p - e.hi) / (e.nx - e.hi) END AS q FROM te ASOF JOIN e ON te.model = e.model AND te.class = e.class AND te.p >= e.start)
"""
_X = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"
#: The logistic curve by Newton steps from the identity.
_SIG = f""", lx AS (SELECT model, class, {_X} AS x, y FROM tr),
nw AS (SELECT DISTINCT model, class, 0 AS step, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM lx
UNION ALL SELECT model, class, step + 1, a + (bb * ga - ab * gb) / (aa * bb - ab * ab), b + (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
SELECT model, class, step, a, b, sum((y - q) * x) AS ga, sum(y - q) AS gb, sum(q * (1 - q) * x * x) AS aa, sum(q * (1 - q) * x) AS ab, sum(q * (1 - q)) AS bb FROM (
SELECT n.*, lx.x, lx.y, 1 / (1 + exp(-(n.a * lx.x + n.b))) AS q FROM nw n JOIN lx ON lx.model = n.model AND lx.class = n.class WHERE n.step < 15) z GROUP BY ALL) s),
sig AS (SELECT te.*, 1 / (1 + exp(-(nw.a * {_X} + nw.b))) AS q FROM te JOIN nw ON te.model = nw.model AND te.class = nw.class AND nw.step = 15)
"""
_HYB = ", hyb AS (SELECT iso.match_id, iso.model, iso.result, iso.class, CASE WHEN iso.p < 0.15 OR iso.p > 1 - 0.15 THEN sig.q ELSE 0.7 * iso.q + (1 - 0.7) * sig.q END AS q FROM iso JOIN sig USING (match_id, model, class))\n"


def _cal_sql(parts: str, name: str, method: str) -> str:
    wide = f", wd AS (SELECT match_id, model, result, " + ", ".join(f"max(CASE WHEN class = '{k.upper()}' THEN q END) AS {k}" for k in "hda") + f" FROM {name} GROUP BY ALL)"
    both = (
        f", al AS (SELECT model, 'raw' AS variant, result, p_h, p_d, p_a FROM j WHERE season >= 1999 UNION ALL SELECT model, '{method}', result, "
        + ", ".join(f"CASE WHEN h + d + a > 0 THEN {k} / (h + d + a) ELSE 1 / 3 END" for k in "hda")
        + " FROM wd)\n"
    )
    return _CAL + parts + wide + both + f"SELECT model, variant, count(*) AS n, {rsql(_METRICS, 4)} FROM al GROUP BY model, variant"


@query("calibrate_isotonic", "9.15 9.34", _cal_sql(_ISO, "iso", "isotonic"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _calibration(spark, sf, "isotonic")


@query("calibrate_platt", "9.16 9.32", _cal_sql(_SIG, "sig", "platt"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _calibration(spark, sf, "platt")


@query("calibrate_hybrid", "9.17", _cal_sql(_ISO + _SIG + _HYB, "hyb", "hybrid"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _calibration(spark, sf, "hybrid")


def _temperature_sql(passes: int = 3, last: int = 24) -> str:
    out = _CAL + ", t0 AS (SELECT DISTINCT model, CAST(0.2 AS DOUBLE) AS lo, CAST(5 AS DOUBLE) AS hi FROM j)"
    parts = {k: f"ln(greatest(p_{k}, 1e-12)) / t" for k in "hda"}
    soft = {k: f"exp({e} - greatest({', '.join(parts.values())}))" for k, e in parts.items()}
    total = " + ".join(soft.values())
    of = " ".join(f"WHEN '{k.upper()}' THEN {soft[k]}" for k in "hda")
    for n in range(1, passes + 1):
        out += f""", l{n} AS (SELECT model, lo, hi, i, avg(-ln(greatest((CASE result {of} END) / ({total}), 1e-15))) AS loss FROM (SELECT j.*, lo, hi, i, lo + (hi - lo) * i / {last} AS t FROM j JOIN t{n - 1} USING (model), range({last + 1}) r(i) WHERE season < 1999) z GROUP BY ALL),
t{n} AS (SELECT model, lo + (hi - lo) * greatest(i - 1, 0) / {last} AS lo, lo + (hi - lo) * least(i + 1, {last}) / {last} AS hi FROM (SELECT model, lo, hi, arg_min(i, loss) AS i FROM l{n} GROUP BY ALL) z)
"""
    out += f", sf AS (SELECT model, result, {', '.join(f'{e} / ({total}) AS p_{k}' for k, e in soft.items())} FROM (SELECT j.*, (lo + hi) / 2 AS t FROM j JOIN t{passes} USING (model) WHERE season >= 1999) z)"
    out += ", al AS (SELECT model, 'raw' AS variant, result, p_h, p_d, p_a FROM j WHERE season >= 1999 UNION ALL SELECT model, 'temperature', result, p_h, p_d, p_a FROM sf)\n"
    return out + f"SELECT model, variant, count(*) AS n, {rsql(_METRICS, 4)} FROM al GROUP BY model, variant"


@query("calibrate_temperature", "9.18 9.31", _temperature_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _calibration(spark, sf, "temperature")


# ---------------------------------------------------------------- training

_FEATURES = ["points_avg5", "goals_scored_avg5", "goals_conceded_avg5"]
_COLS = [f"{s}_{c}" for s in "ha" for c in _FEATURES]


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Form of both sides before each match with the result class and a fold by season."""
    m = inputs.matches(spark, sf)
    rolled = form.rolling(form.team_game_log(m), {"points": "points", "goals_scored": "scored", "goals_conceded": "conceded"}, (5,), ["team"])
    sides = form.to_match_rows(rolled, _FEATURES)
    label = F.when(F.col("result") == "H", 2.0).when(F.col("result") == "D", 1.0).otherwise(0.0)
    base = m.select("match_id", "season", "result", "home_goals", "away_goals", "odds_h", "odds_d", "odds_a", "odds_over", label.alias("label"))
    first = m.agg(F.min("season")).scalar()
    # Training passes over the table many times, so it is written once.
    return written(
        base.join(sides, "match_id").withColumn("fold", F.floor((F.col("season") - first) / 3).cast("int")), "training"
    )


def _train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    data = _training(spark, sf)
    return data.filter("season < 2000"), data.filter("season >= 2000")


@query("train_classifiers", "9.6 9.9 9.38")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)
    train = train.withColumn("w", F.when(F.col("label") == 1, 1.5).otherwise(1.0))
    out = None
    for name in ("lr", "rf", "mlp"):
        model = learning.train(train, _COLS, name, None if name == "mlp" else "w")
        s = learning.score(model, test, ["match_id", "result"]).withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    named = out.withColumnsRenamed({"p0": "p_a", "p1": "p_d", "p2": "p_h"})
    return rounded(ev.outcome_metrics(named, ["model"]), ["model", "n"], ["accuracy", "brier", "log_loss"], 3)


@query("train_boosted_binary", "9.36 9.35")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = (d.withColumn("label", (F.col("home_goals") + F.col("away_goals") > 2.5).cast("double")) for d in _train_test(spark, sf))
    model = learning.train(train, _COLS, "gbt", classes=2, maxIter=5)
    return learning.score(model, test, ["match_id", "label"], 2).select("match_id", F.round("p1", 4).alias("p_over"))


_PRICED = [*_COLS, "i_h", "i_d", "i_a", "i_over"]


def _priced(d: DataFrame) -> DataFrame:
    return d.withColumns({f"i_{c}": 1 / F.col(f"odds_{c}") for c in ("h", "d", "a", "over")})


@query("train_boosted_outcome", "9.6 9.36")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Result probabilities by three-class boosting, stopped on the two seasons before the test seasons, beside a logistic model; recent seasons weigh more."""
    train, test = (_priced(d) for d in _train_test(spark, sf))
    train = train.withColumn("w", F.exp(F.lit(math.log(0.5) / 3) * (1999 - F.col("season"))))
    params = BoostingParams(learning_rate=0.15, subsample=0.8, feature_share=0.8)
    trees = fit_boosted(train, _PRICED, "label", ["match_id"], valid=F.col("season") >= 1998, weight="w", params=params)
    linear = learning.score(learning.train(train, _PRICED, "lr", "w"), test, ["match_id", "result"])
    both = trees.probabilities(test).select("match_id", "result", "p0", "p1", "p2", F.lit("boosted").alias("model")).unionByName(
        linear.drop("prediction").withColumn("model", F.lit("lr"))
    )
    named = both.withColumnsRenamed({"p0": "p_a", "p1": "p_d", "p2": "p_h"})
    return rounded(ev.outcome_metrics(named, ["model"]), ["model", "n"], ["accuracy", "brier", "log_loss"], 3)


@query("tune_by_time_folds", "9.7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    data = _training(spark, sf).select("fold", "label", *_COLS)
    grid = {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}
    rows = learning.tune(data, _COLS, "lr", grid, "fold")
    return spark.createDataFrame([(r["regParam"], r["elasticNetParam"], round(x, 4)) for r, x in rows], "reg double, mix double, log_loss double")


def _searched(spark: SparkSession, trials: list[tuning.Trial]) -> DataFrame:
    """A row per setting and scored fold, settings from the best to the worst."""
    rows = [(rank, t.place, json.dumps(t.settings, sort_keys=True), f, loss) for rank, t in enumerate(trials, 1) for f, loss in t.losses.items()]
    out = spark.createDataFrame(rows, "rank int, trial int, settings string, fold int, log_loss double")
    return rounded(out, ["rank", "trial", "settings", "fold"], ["log_loss"], 4)


@query("search_linear_random", "9.7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    space = {"regParam": tuning.Between(1e-4, 1.0, log=True), "elasticNetParam": [0.0, 0.25, 0.5, 1.0]}
    return _searched(spark, tuning.search(_priced(_training(spark, sf)), _PRICED, "lr", tuning.random_settings(space, 10), "fold", ["match_id"]))


@query("search_forest_halving", "9.7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    space = {"numTrees": [100, 200], "maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 5, 20], "featureSubsetStrategy": ["sqrt", "log2"]}
    settings = tuning.random_settings(space, 6)
    return _searched(spark, tuning.search(_priced(_training(spark, sf)), _PRICED, "rf", settings, "fold", ["match_id"], halving=3))


@query("stacked_models", "9.5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    data = _training(spark, sf)
    names = ["lr", "rf"]
    oof = learning.out_of_fold(data, _COLS, names, "fold", ["match_id", "label", "fold"])
    wide = learning.side_by_side(oof, names, ["match_id", "label", "fold"])
    out = None
    for f in range(2, int(data.agg(F.max("fold")).first()[0]) + 1):  # the first fold has no base models, the second no meta model
        meta = learning.stack(oof.filter(F.col("fold") < f), names, ["match_id", "label", "fold"])
        part = learning.score(meta, wide.filter(F.col("fold") == f), ["match_id"])
        out = part if out is None else out.unionByName(part)
    return out.select("match_id", *[F.round(f"p{i}", 4).alias(f"p{i}") for i in range(3)])


@query("poisson_btts", "9.8")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)
    out = learning.poisson_btts(train, test, _COLS, "home_goals", "away_goals", ["match_id"])
    return rounded(out, ["match_id"], ["lam", "mu", "p_btts"], 4)


@query("btts_from_market_forest", "7.14")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)

    def ready(d: DataFrame) -> DataFrame:
        return d.withColumns(
            {f"i_{c}": 1 / F.col(c) for c in ("odds_h", "odds_d", "odds_a", "odds_over")}
            | {"label": ((F.col("home_goals") > 0) & (F.col("away_goals") > 0)).cast("double")}
        )

    cols = [f"i_{c}" for c in ("odds_h", "odds_d", "odds_a", "odds_over")]
    model = learning.train(ready(train), cols, "rf", classes=2, numTrees=20)
    return learning.score(model, ready(test), ["match_id"], 2).select("match_id", F.round("p1", 4).alias("p_btts"))


@query("select_by_forest", "9.19 9.25 9.26")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_test(spark, sf)
    ranked = learning.importances(learning.train(train, _COLS, "rf", numTrees=10), _COLS)
    kept = learning.eliminate(train, _COLS, 4)
    over = learning.above_threshold(ranked, 0.1)
    return spark.createDataFrame([(n, round(v, 3), n in kept, n in over) for n, v in ranked], "feature string, importance double, kept boolean, over boolean")


@query("select_sequential", "9.28")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _train_test(spark, sf)
    chosen = learning.sequential(train, test, _COLS, 2)
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen, 1)], "place int, feature string")


@query("select_l1_and_univariate", "9.29 9.19")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_test(spark, sf)
    l1, top = learning.l1_features(train, _COLS, 0.005), learning.univariate(train, _COLS, 3)
    return spark.createDataFrame([(c, c in l1, c in top) for c in _COLS], "feature string, l1 boolean, univariate boolean")


_MI = ["home_shots", "away_shots", "home_sot", "away_sot"]


@query(
    "mutual_information",
    "9.27",
    MW
    + ", l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS bin, result AS y FROM matches" for c in _MI)
    + """), n AS (SELECT feature, bin, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature, bin) AS nb, sum(count(*)) OVER (PARTITION BY feature, y) AS ny, sum(count(*)) OVER (PARTITION BY feature) AS t FROM l GROUP BY feature, bin, y)
SELECT feature, round(CAST(sum(n / t * ln(n * t / (nb * ny))) AS DOUBLE), 6) AS mi FROM n GROUP BY feature""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    codes = inputs.matches(spark, sf).select(F.col("result").alias("y"), *[F.col(c).cast("double").alias(c) for c in _MI])
    return rounded(learning.mutual_information(codes, _MI, "y", codes=codes), ["feature"], ["mi"])


_RED = ["home_goals", "home_shots", "home_sot", "away_goals", "away_shots"]


@query(
    "redundant_features",
    "9.20 9.30",
    MW
    + ", c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM matches" for i, a in enumerate(_RED) for b in _RED[i + 1 :])
    + "), k AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS f, abs(corr({c}, home_goals - away_goals)) AS v FROM matches" for c in _RED)
    + ") SELECT DISTINCT CASE WHEN x.v >= y.v THEN b ELSE a END AS feature FROM c JOIN k x ON x.f = a JOIN k y ON y.f = b WHERE abs(r) > 0.3",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    diff = F.col("home_goals") - F.col("away_goals")
    ranking = m.agg(*[F.abs(F.corr(c, diff)).alias(c) for c in _RED]).unpivot([], _RED, "feature", "importance")
    return learning.drop_redundant(learning.redundant_pairs(aggregates.correlation_pairs(m, _RED), 0.3), ranking)


@query("market_blend_scoring", "9.9 9.38", _J + _BLEND + f"SELECT count(*) AS n, {rsql(_METRICS)} FROM b")
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = ev.blend(_preds(spark, sf), _W, keep=("result",))
    return rounded(ev.outcome_metrics(b, []), ["n"], list(_METRICS))
