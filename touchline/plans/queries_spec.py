"""Declarative feature lists, SQL functions and custom computers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans import inputs, spec
from touchline.plans.common import rounded
from touchline.plans.registry import query

MW = inputs.sql_with("matches")
TGW = inputs.sql_with("team_games")
_PAST = "OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_LIST = """{"features": [{"type": "form", "params": {"windows": [5], "metrics": ["points"]}}, {"type": "rest_days"},
 {"type": "market"}, {"type": "head_to_head", "enabled": false}, {"type": "calendar"}]}"""


@query(
    "feature_list",
    "13.1 13.2 13.3",
    TGW
    + f""", g AS (SELECT match_id, is_home, avg(points) {_PAST} AS p, CAST(datediff('day', lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), match_date) AS INT) AS r FROM team_games)
SELECT m.match_id, round(h.p, 6) AS h_points_avg5, round(a.p, 6) AS a_points_avg5, h.r AS h_rest_days, a.r AS a_rest_days, CAST(isodow(match_date) - 1 AS INT) AS day_of_week, round(close_h - odds_h, 6) AS movement_home
FROM matches m JOIN g h ON h.match_id = m.match_id AND h.is_home = 1 JOIN g a ON a.match_id = m.match_id AND a.is_home = 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = spec.FeatureList.from_json(_LIST)(inputs.matches(spark, sf))
    return rounded(out, ["match_id", "h_rest_days", "a_rest_days", "day_of_week"], ["h_points_avg5", "a_points_avg5", "movement_home"])


@query(
    "sql_functions",
    "13.5 13.6",
    inputs.sql_with("matches", "preds")
    + """SELECT match_id, model, round(p_h * odds_h - 1, 6) AS ev, round(CASE WHEN p_h * odds_h > 1 THEN least((p_h * odds_h - 1) / (odds_h - 1), 1) ELSE 0 END, 6) AS kelly, round((odds_h - close_h) / close_h, 6) AS clv
FROM preds JOIN matches USING (match_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec.register_functions(spark)
    p = inputs.preds(spark, sf, ("odds_h", "close_h"))
    return p.selectExpr(
        "match_id", "model", "round(expected_value(p_h, odds_h), 6) AS ev", "round(kelly_fraction(p_h, odds_h), 6) AS kelly", "round(closing_line_value(odds_h, close_h), 6) AS clv"
    )


@query(
    "sql_score_grid",
    "13.5 6.14",
    MW
    + """, g AS (SELECT i, j FROM (SELECT unnest(range(0, 6)) AS i) a, (SELECT unnest(range(0, 6)) AS j) b)
SELECT match_id, CAST(i AS INT) AS home_score, CAST(j AS INT) AS away_score, round(exp(-(home_xg + 0.3)) * pow(home_xg + 0.3, i) / factorial(CAST(i AS INT)) * exp(-(away_xg + 0.3)) * pow(away_xg + 0.3, j) / factorial(CAST(j AS INT)), 8) AS probability FROM matches, g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec.register_functions(spark)
    m = inputs.matches(spark, sf).selectExpr("match_id", "home_xg + 0.3D AS lam", "away_xg + 0.3D AS mu")
    out = spark.sql("SELECT m.match_id, g.* FROM {m} m, LATERAL score_grid(m.lam, m.mu) g", m=m)
    return rounded(out, ["match_id", "home_score", "away_score"], ["probability"], 8)


@query("custom_computers", "13.4 13.7", "SELECT user_id, count(*) AS n, round(sum(value * 2), 4) AS doubled FROM events GROUP BY user_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, n, total = None, 0, 0.0
        for b in batches:
            user, n, total = b["user_id"].iloc[0], n + len(b), total + float(b["doubled"].sum())
        if n:
            yield pd.DataFrame({"user_id": [user], "n": [n], "doubled": [total]})

    e = spec.compute_column(inputs.table(spark, sf, "events").select("user_id", "value"), "doubled", lambda c: c["value"] * 2)
    # Each user's events are split over salts, computed per part and added up.
    e = e.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(8)))
    parts = e.groupBy("user_id", "part").applyInPandas(count, "user_id bigint, n bigint, doubled double")
    return parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("doubled"), 4).alias("doubled"))
