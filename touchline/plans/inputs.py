"""Match, odds, prediction and squad tables derived from the given star schema.

Each table exists twice, as a DataFrame and as a SQL common table expression, and both are built
from the same column expressions, so a query and its SQL check see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column name -> expression over one order, its first line item and the joined dimensions.
_MATCH_EXPR = {
    "match_id": "o_orderkey",
    "match_date": "CAST(o_orderdate AS DATE)",
    "season": "CAST(year(o_orderdate) AS INT)",
    "league": "r_name",
    "home_team": "home_name",
    "away_team": "away_name",
    "home_goals": "CAST(l_quantity AS INT) % 5",
    "away_goals": "CAST(l_partkey % 4 AS INT)",
    "result": "CASE WHEN CAST(l_quantity AS INT) % 5 > l_partkey % 4 THEN 'H' "
    "WHEN CAST(l_quantity AS INT) % 5 < l_partkey % 4 THEN 'A' ELSE 'D' END",
    "home_xg": "(l_partkey % 70) / 31e0",
    "away_xg": "(l_suppkey % 50) / 29e0",
    "home_shots": "CAST(l_quantity AS INT) % 5 + CAST(l_suppkey % 12 AS INT)",
    "away_shots": "CAST(l_partkey % 4 AS INT) + CAST(l_partkey % 11 AS INT)",
    "home_sot": "CAST(l_quantity AS INT) % 5 + CAST(l_suppkey % 4 AS INT)",
    "away_sot": "CAST(l_partkey % 4 AS INT) + CAST(l_partkey % 3 AS INT)",
    "odds_h": "1.3e0 + (l_partkey % 300) / 100e0",
    "odds_d": "2.8e0 + (l_suppkey % 17) / 10e0",
    "odds_a": "1.5e0 + (floor(l_extendedprice) % 400) / 100e0",
    "close_h": "(1.3e0 + (l_partkey % 300) / 100e0) * (1e0 + l_discount - l_tax)",
    "close_d": "2.8e0 + (l_suppkey % 17) / 10e0",
    "close_a": "(1.5e0 + (floor(l_extendedprice) % 400) / 100e0) * (1e0 - l_discount + l_tax)",
    "odds_over": "1.4e0 + (l_partkey % 150) / 100e0",
    "odds_under": "1.5e0 + (l_suppkey % 140) / 100e0",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'finished' ELSE 'playing' END",
    "attendance": "CAST(floor(o_totalprice / 10e0) AS INT)",
    "referee_id": "l_suppkey",
}

_FIRST_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

MATCHES_CTE = (
    """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY """
    + ", ".join(_FIRST_LINE)
    + """) rn FROM lineitem),
matches AS (SELECT """
    + ", ".join(f"{e} AS {n}" for n, e in _MATCH_EXPR.items())
    + """ FROM orders JOIN li ON l_orderkey = o_orderkey AND rn = 1
 JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
 JOIN (SELECT n_nationkey home_key, n_name home_name, n_regionkey home_region FROM nation) hn ON home_key = c_nationkey
 JOIN (SELECT n_nationkey away_key, n_name away_name FROM nation) an ON away_key = s_nationkey
 JOIN region ON r_regionkey = home_region WHERE home_key <> away_key)"""
)

# One row per side; points and flags from that side's view.
_SIDE = {
    "H": "match_id, match_date, season, league, home_team AS team, away_team AS opponent, 1 AS is_home, "
    "home_goals AS scored, away_goals AS conceded, home_xg AS xg, away_xg AS xga, home_shots AS shots, home_sot AS sot, "
    "CASE result WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS points",
    "A": "match_id, match_date, season, league, away_team AS team, home_team AS opponent, 0 AS is_home, "
    "away_goals AS scored, home_goals AS conceded, away_xg AS xg, home_xg AS xga, away_shots AS shots, away_sot AS sot, "
    "CASE result WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS points",
}
TEAM_GAMES_CTE = (
    f"team_games AS (SELECT {_SIDE['H']} FROM matches UNION ALL SELECT {_SIDE['A']} FROM matches)"
)

_BOOK_EXPR = {
    "odds_h": "1.3e0 + (l_partkey % 300) / 100e0",
    "odds_d": "2.8e0 + (l_suppkey % 17) / 10e0",
    "odds_a": "1.5e0 + (floor(l_extendedprice) % 400) / 100e0",
    "close_h": "(1.3e0 + (l_partkey % 300) / 100e0) * (1e0 + l_discount - l_tax)",
    "close_d": "2.8e0 + (l_suppkey % 17) / 10e0",
    "close_a": "(1.5e0 + (floor(l_extendedprice) % 400) / 100e0) * (1e0 - l_discount + l_tax)",
}
BOOKS_CTE = (
    "books AS (SELECT match_id, 'B' || CAST(l_linenumber AS VARCHAR) AS bookmaker, "
    + ", ".join(f"max({e}) AS {n}" for n, e in _BOOK_EXPR.items())
    + ", max(CAST(l_shipdate AS DATE)) AS quoted_on FROM lineitem JOIN (SELECT match_id FROM matches) mm"
    " ON match_id = l_orderkey GROUP BY 1, 2)"
)

# Model weights per class; the probabilities are the weights divided by their sum.
_MODEL_WEIGHTS = {
    "ensemble": ("1e0 + home_shots", "2e0 + home_sot % 3", "1e0 + away_shots"),
    "goals": ("0.5e0 + home_xg", "0.8e0", "0.5e0 + away_xg"),
    "market": ("1e0 / odds_h", "1e0 / odds_d", "1e0 / odds_a"),
}
PREDS_CTE = "preds AS (SELECT match_id, model, w_h / (w_h + w_d + w_a) AS p_h, w_d / (w_h + w_d + w_a) AS p_d, w_a / (w_h + w_d + w_a) AS p_a FROM (" + " UNION ALL ".join(
    f"SELECT match_id, '{m}' AS model, {h} AS w_h, {d} AS w_d, {a} AS w_a FROM matches"
    for m, (h, d, a) in _MODEL_WEIGHTS.items()
) + ") w)"

_PLAYER_EXPR = {
    "player_id": "c_custkey",
    "player_name": "c_name",
    "team": "n_name",
    "position": "c_mktsegment",
    "market_value": "greatest(c_acctbal, 0e0) / 100e0",
    "age": "CAST(17 + c_custkey % 20 AS INT)",
    "injured": "CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END",
    "suspended": "CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END",
    "goals": "CAST(c_custkey % 31 AS INT)",
}
PLAYERS_CTE = (
    "players AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _PLAYER_EXPR.items())
    + " FROM customer JOIN nation ON n_nationkey = c_nationkey)"
)

_PARTS = {
    "matches": (MATCHES_CTE, ()),
    "team_games": (TEAM_GAMES_CTE, ("matches",)),
    "books": (BOOKS_CTE, ("matches",)),
    "preds": (PREDS_CTE, ("matches",)),
    "players": (PLAYERS_CTE, ()),
}


def sql_with(*tables: str, more: str = "") -> str:
    """`WITH ...` text that defines the named tables (and what they build on), then `more`."""
    order: list[str] = []
    for t in tables:
        for need in (*_PARTS[t][1], t):
            if need not in order:
                order.append(need)
    parts = [_PARTS[t][0] for t in order]
    if more:
        parts.append(more)
    return "WITH " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixture per order whose customer and first supplier come from different nations."""
    first = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct(*_FIRST_LINE)).alias("first"))
        .select("l_orderkey", "first.*")
    )
    nation = table(spark, sf_dir, "nation")
    home = nation.select(
        F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home_name"), F.col("n_regionkey").alias("home_region")
    )
    away = nation.select(F.col("n_nationkey").alias("away_key"), F.col("n_name").alias("away_name"))
    return (
        table(spark, sf_dir, "orders")
        .join(first, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(home, F.col("home_key") == F.col("c_nationkey"))
        .join(away, F.col("away_key") == F.col("s_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("home_region"))
        .filter("home_key <> away_key")
        .selectExpr(*[f"{e} AS {n}" for n, e in _MATCH_EXPR.items()])
    )


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.operators.form import team_game_log

    return team_game_log(matches(spark, sf_dir))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of several bookmakers per match: one line item of the order is one quote."""
    line = table(spark, sf_dir, "lineitem")
    ids = matches(spark, sf_dir).select("match_id")
    return (
        line.join(ids, F.col("l_orderkey") == F.col("match_id"))
        .groupBy("match_id", F.expr("'B' || CAST(l_linenumber AS STRING)").alias("bookmaker"))
        .agg(
            *[F.max(F.expr(e)).alias(n) for n, e in _BOOK_EXPR.items()],
            F.max(F.expr("CAST(l_shipdate AS DATE)")).alias("quoted_on"),
        )
    )


def preds(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Probability triples of three simple models per match; `keep` carries match columns along."""
    variants = ", ".join(
        f"struct('{m}' AS model, {h} AS w_h, {d} AS w_d, {a} AS w_a)" for m, (h, d, a) in _MODEL_WEIGHTS.items()
    )
    w = matches(spark, sf_dir).selectExpr("match_id", *keep, f"explode(array({variants})) AS v")
    total = "(v.w_h + v.w_d + v.w_a)"
    return w.selectExpr(
        "match_id", *keep, "v.model AS model", f"v.w_h / {total} AS p_h", f"v.w_d / {total} AS p_d", f"v.w_a / {total} AS p_a"
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(
        *[f"{e} AS {n}" for n, e in _PLAYER_EXPR.items()]
    )
