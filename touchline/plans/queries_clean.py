"""Cleaning, typing, deduplication and scalar parsing over texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import dates, text
from touchline.operators import clean
from touchline.plans import inputs
from touchline.plans.common import rounded
from touchline.plans.registry import query

MW = inputs.sql_with("matches")


@query(
    "calendar_features",
    "2.1 2.2 2.3",
    MW
    + """, s AS (SELECT match_id, match_date, CAST(year(match_date) - CAST(month(match_date) < 8 AS INT) AS INT) AS st FROM matches)
SELECT match_id, CAST(year(match_date) AS INT) AS year, CAST(month(match_date) AS INT) AS month, CAST(isodow(match_date) - 1 AS INT) AS day_of_week,
 CAST(dayofyear(match_date) AS INT) AS day_of_year, st AS season_start, CAST(datediff('day', make_date(st, 8, 1), match_date) // 7 + 1 AS INT) AS week_of_season,
 CAST(isodow(match_date) IN (2, 3, 4) AS INT) AS is_midweek FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["year", "month", "day_of_week", "day_of_year", "season_start", "week_of_season", "is_midweek"]
    return clean.calendar_features(inputs.matches(spark, sf)).select("match_id", *cols)


@query(
    "outcome_columns",
    "2.22 2.45",
    MW
    + """SELECT match_id, CASE result WHEN 'H' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS target, home_goals - away_goals AS goal_diff, home_goals + away_goals AS total_goals,
 CAST(home_goals + away_goals > 2.5 AS INT) AS over_2_5, CAST(home_goals > 0 AND away_goals > 0 AS INT) AS btts FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.outcome_columns(inputs.matches(spark, sf)).select("match_id", "target", "goal_diff", "total_goals", "over_2_5", "btts")


def date_texts(df: DataFrame) -> DataFrame:
    """The match date written in five layouts; every sixth row holds no date."""
    layouts = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd"]
    t = F.lit("unknown")
    for i, f in enumerate(layouts):
        t = F.when(F.col("match_id") % 6 == i, F.date_format("match_date", f)).otherwise(t)
    return df.withColumn("date_text", t)


_DATE_TEXT = "CASE match_id % 6 " + " ".join(
    f"WHEN {i} THEN strftime(match_date, '{f}')" for i, f in enumerate(["%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y%m%d"])
) + " ELSE 'unknown' END"


@query(
    "parse_dates_flexible",
    "2.11",
    MW
    + f""", t AS (SELECT match_id, {_DATE_TEXT} AS s FROM matches)
SELECT match_id, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%d-%m-%Y'), try_strptime(s, '%Y%m%d')) AS DATE) AS parsed FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return date_texts(inputs.matches(spark, sf)).select("match_id", dates.parse_date_flexible(F.col("date_text")).alias("parsed"))


# Money texts of different shapes from the whole part of the balance.
_AMOUNT = "CAST(CAST(floor(abs(c_acctbal)) AS INT) AS {s})"
_MONEY = (
    "CASE c_custkey % 7 WHEN 0 THEN '€' || {n} || 'm' WHEN 1 THEN '€' || {n} || 'k' WHEN 2 THEN '€1.' || {n} || 'bn' WHEN 3 THEN {n} || 'Tsd.' "
    "WHEN 4 THEN '-' WHEN 5 THEN ' ' || {n} || '.5m ' ELSE 'n/a' END"
)
_FEE = (
    "CASE c_custkey % 6 WHEN 0 THEN 'Free Transfer' WHEN 1 THEN 'Loan fee: €' || {n} || ',5m' WHEN 2 THEN '€' || {n} || 'k' WHEN 3 THEN 'End of loan' "
    "WHEN 4 THEN '€' || {n} || '.25m' ELSE '?' END"
)


def _spark_text(template: str) -> str:
    return template.replace("{n}", _AMOUNT.format(s="STRING"))


@query(
    "parse_money",
    "2.8 2.9",
    """SELECT c_custkey, round(CASE c_custkey % 7 WHEN 0 THEN n WHEN 1 THEN n / 1000 WHEN 2 THEN CAST('1.' || CAST(CAST(n AS INT) AS VARCHAR) AS DOUBLE) * 1000 WHEN 3 THEN n / 1000 WHEN 5 THEN n + 0.5 ELSE 0 END, 6) AS market_value,
 round(CASE c_custkey % 6 WHEN 1 THEN n + 0.5 WHEN 2 THEN n / 1000 WHEN 4 THEN n + 0.25 ELSE 0 END, 6) AS fee FROM (SELECT c_custkey, floor(abs(c_acctbal)) AS n FROM customer) c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.table(spark, sf, "customer").selectExpr("c_custkey", f"{_spark_text(_MONEY)} AS v", f"{_spark_text(_FEE)} AS f")
    out = c.select("c_custkey", text.parse_market_value(F.col("v")).alias("market_value"), text.parse_transfer_fee(F.col("f")).alias("fee"))
    return rounded(out, ["c_custkey"], ["market_value", "fee"])


_POS_TEXT = "CASE c_custkey % 9 WHEN 0 THEN ' gk' WHEN 1 THEN 'Goalkeeper' WHEN 2 THEN 'lwb' WHEN 3 THEN 'Central Defender' WHEN 4 THEN 'CAM' WHEN 5 THEN 'midfield' WHEN 6 THEN 'Forward' WHEN 7 THEN 'ST' ELSE c_mktsegment END"
_FLAG_TEXT = "CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN 'maybe' ELSE NULL END"


@query(
    "parse_positions_flags",
    "2.4 2.10",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 9 IN (0, 1) THEN 'GK' WHEN c_custkey % 9 IN (2, 3) THEN 'DEF' WHEN c_custkey % 9 IN (4, 5) THEN 'MID'
 WHEN c_custkey % 9 IN (6, 7) THEN 'FWD' ELSE 'MID' END AS pos, c_custkey % 6 < 3 AS flag FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.table(spark, sf, "customer").selectExpr("c_custkey", f"{_POS_TEXT} AS p", f"{_FLAG_TEXT} AS f")
    return c.select("c_custkey", text.position_group(F.col("p")).alias("pos"), text.parse_boolean(F.col("f")).alias("flag"))


_CLUB = "CASE s_suppkey % 5 WHEN 0 THEN 'FC ' || s_name WHEN 1 THEN s_name || ' United' WHEN 2 THEN ' AC ' || s_name || ' fc' WHEN 3 THEN 'Real-' || s_name ELSE s_name || '  City ' END"


@query(
    "team_keys",
    "2.31 2.42 2.39",
    f"""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 3 THEN 'real' ELSE '' END || regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS team_key,
 s_suppkey % 2 = 0 AS placeholder, CAST(s_suppkey % 5 = 0 AND FALSE AS INT) AS derby FROM supplier""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_CLUB} AS club", "CASE WHEN s_suppkey % 2 = 0 THEN 'W' ELSE 'X' END || CAST(s_suppkey AS STRING) AS slot", "s_name")
    return s.select(
        "s_suppkey", text.team_key(F.col("club")).alias("team_key"), text.is_placeholder_team(F.col("slot")).alias("placeholder"),
        text.same_first_token(F.col("club"), F.lit("other club")).alias("derby"),
    )


# Competition names: a label from the importance list in front of the region.
_COMP = [
    ("FIFA World Cup", 2.5), ("World Cup Qualifying", 2.5), ("UEFA Europa League", 2.0), ("Champions League", 1.3), ("Club Friendly", 0.6),
    ("Nations League", 1.5), ("Regional", 1.0),
]
_ROUNDS = ["Final", "Group A", "Round of 16", "Semi-finals"]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(
    "competition_importance",
    "2.25 2.26 6.20",
    MW
    + f""", c AS (SELECT match_id, {_case('match_id % 7', [str(w) for _, w in _COMP])} AS w, match_id % 4 AS r FROM matches)
SELECT match_id, CAST(w AS DOUBLE) AS weight, round(CAST(w AS DOUBLE) * CASE WHEN CAST(w AS DOUBLE) >= 1.5 AND r <> 1 THEN 1.2 ELSE 1 END, 6) AS weight_round,
 CASE match_id % 7 WHEN 1 THEN 1.5e0 WHEN 2 THEN 1.2e0 WHEN 4 THEN 0.4e0 ELSE CAST(w AS DOUBLE) END AS weight_longest FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).selectExpr(
        "match_id", f"{_case('match_id % 7', [n for n, _ in _COMP])} || ' ' || league AS comp", f"{_case('match_id % 4', _ROUNDS)} AS rnd"
    )
    # Region names hold no fragment of the list except EUROPE, which is replaced.
    comp = F.regexp_replace("comp", "EUROPE$", "E")
    return m.select(
        "match_id", text.competition_importance(comp).alias("weight"),
        F.round(text.competition_importance(comp, F.col("rnd")), 6).alias("weight_round"),
        text.competition_importance(comp, longest=True).alias("weight_longest"),
    )


@query(
    "sample_weights",
    "2.27 2.28",
    MW
    + "SELECT match_id, round(exp(-ln(2e0) * greatest(datediff('day', match_date, (SELECT max(match_date) FROM matches)) + 1, 0) / 180e0), 9) AS weight FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.sample_weights(inputs.matches(spark, sf), "match_date", 180.0), ["match_id"], ["weight"], 9)


_ALIAS_SQL = "al AS (SELECT lower(n_name) || ' fc' AS alias, n_name AS canonical FROM nation WHERE n_nationkey % 2 = 0)"


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").selectExpr("lower(n_name) || ' fc' AS alias", "n_name AS canonical")


@query(
    "canonical_names",
    "2.12 2.13",
    MW
    + f""", {_ALIAS_SQL}, r AS (SELECT match_id, '  ' || home_team || ' FC' AS home_team, away_team || ' FC ' AS away_team FROM matches)
SELECT match_id, coalesce(h.canonical, trim(home_team)) AS home_team, coalesce(a.canonical, trim(away_team)) AS away_team FROM r
LEFT JOIN al h ON h.alias = lower(trim(home_team)) LEFT JOIN al a ON a.alias = lower(trim(away_team))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.matches(spark, sf).selectExpr("match_id", "'  ' || home_team || ' FC' AS home_team", "away_team || ' FC ' AS away_team")
    return clean.canonical_names(r, ["home_team", "away_team"], _aliases(spark, sf))


@query(
    "strip_club_words",
    "2.13",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Club Of ' ELSE '' END || upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) AS cleaned FROM supplier""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 'club of ' || lower(s_name) WHEN 1 THEN upper(s_name) || ' Wanderers' ELSE s_name || ' (U23) FC' END AS n"
    )
    return s.select("s_suppkey", clean.strip_club_words(F.col("n")).alias("cleaned"))


@query(
    "select_and_map_columns",
    "2.14 2.15 2.50",
    MW + "SELECT match_id AS id, upper(league) AS league, season, odds_h FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = clean.drop_leaky_columns(inputs.matches(spark, sf))
    out = clean.select_columns(m, keep=["id", "league", "season", "odds_h", "absent"], rename={"match_id": "id"})
    return clean.map_column(out, "league", F.upper)


_DIRTY = "match_id, '  ' || league || ' ' AS league, CASE WHEN match_id % 10 = 0 THEN 'x' ELSE CAST(home_shots AS {s}) END AS shots, CASE WHEN match_id % 7 <> 0 THEN home_xg * 4 END AS xg"


@query(
    "clean_records",
    "2.16",
    MW
    + f""", d AS (SELECT {_DIRTY.format(s='VARCHAR')} FROM matches),
c AS (SELECT match_id, trim(league) AS league, CASE WHEN try_cast(shots AS DOUBLE) IS NOT NULL THEN least(greatest(try_cast(shots AS DOUBLE), 2), 12) END AS shots, xg FROM d)
SELECT match_id, league, round(coalesce(shots, (SELECT avg(shots) FROM c)), 6) AS shots, round(coalesce(xg, (SELECT avg(xg) FROM c)), 6) AS xg FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = inputs.matches(spark, sf).selectExpr(*[f"{c.strip()}" for c in _DIRTY.format(s="STRING").split(", ")])
    rules = clean.CleanRules(
        casts={"shots": "double"}, clip={"shots": (2.0, 12.0)}, fill="mean", fill_columns=("shots", "xg"), unique_by=("match_id",)
    )
    return rounded(clean.clean(d, rules), ["match_id", "league"], ["shots", "xg"])


_COPIES = "SELECT *, {k} AS copy FROM matches"


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies of every match; the second misses its odds for some rows."""
    m = inputs.matches(spark, sf).select("match_id", "match_date", "home_team", "away_team", "league", "home_xg", "odds_h", "odds_d")
    return m.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "odds_h", F.when((F.col("copy") == 1) | (F.col("match_id") % 3 != 0), F.col("odds_h"))
    )


_COPIES_SQL = """, cp AS (SELECT match_id, match_date, home_team, away_team, league, home_xg, odds_h, odds_d, 1 AS copy FROM matches UNION ALL
 SELECT match_id, match_date, home_team, away_team, league, home_xg, CASE WHEN match_id % 3 <> 0 THEN odds_h END, odds_d, 2 FROM matches)"""


@query(
    "dedupe_most_complete",
    "2.17",
    MW
    + _COPIES_SQL
    + """, k AS (SELECT *, copy * 1000000000 + match_id AS newest FROM cp)
SELECT match_date, home_team, away_team, match_id, copy FROM k QUALIFY row_number() OVER (PARTITION BY match_date, home_team, away_team
 ORDER BY CAST(odds_h IS NOT NULL AS INT) DESC, newest DESC) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = _copies(spark, sf).withColumn("newest", F.col("copy") * 1000000000 + F.col("match_id"))
    out = clean.dedupe_most_complete(c, ["match_date", "home_team", "away_team"], "newest")
    return out.select("match_date", "home_team", "away_team", "match_id", "copy")


@query(
    "dedupe_latest",
    "2.18 2.19",
    MW
    + _COPIES_SQL
    + ", l AS (SELECT match_id, copy FROM cp WHERE copy = 2) SELECT l.match_id, l.copy FROM l WHERE l.match_id IN (SELECT min(match_id) FROM matches GROUP BY match_date, home_team, away_team)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    latest = clean.dedupe_latest(_copies(spark, sf), ["match_id"], "copy")
    return clean.dedupe_smallest_id(latest, ["match_date", "home_team", "away_team"], "match_id").select("match_id", "copy")


_GAPS = """match_id, match_date, CASE WHEN match_id % 13 <> 0 THEN home_team END AS home_team, away_team, CASE WHEN match_id % 11 <> 0 THEN result END AS result,
 CASE WHEN match_id % 5 <> 0 THEN home_shots END AS home_shots, CASE WHEN match_id % 4 = 0 THEN away_shots END AS away_shots"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.matches(spark, sf).selectExpr(*[c.strip() for c in _GAPS.split(",")])


@query(
    "missing_fill_zero",
    "2.20",
    MW
    + f""", g AS (SELECT {_GAPS} FROM matches) SELECT match_id, coalesce(home_team, last_value(home_team IGNORE NULLS) OVER (ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS home_team,
 away_team, result, coalesce(home_shots, 0) AS home_shots FROM g QUALIFY result IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = clean.handle_missing(_gaps(spark, sf), "fill_zero", 60.0, ["match_date", "match_id"])
    return out.drop("match_date")


@query(
    "missing_fill_median",
    "2.20",
    MW
    + f", g AS (SELECT {_GAPS} FROM matches) SELECT match_id, result, coalesce(home_shots, (SELECT median(home_shots) FROM g)) AS home_shots FROM g WHERE result IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.handle_missing(_gaps(spark, sf), "fill_median", 60.0).select("match_id", "result", "home_shots")


@query("missing_drop", "2.20", MW + f", g AS (SELECT {_GAPS} FROM matches) SELECT match_id, home_shots FROM g WHERE home_team IS NOT NULL AND result IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.handle_missing(_gaps(spark, sf), "drop", 60.0).select("match_id", "home_shots")


@query(
    "standardise_schema",
    "2.21 2.5",
    MW + "SELECT match_id, CAST(season AS VARCHAR) AS season, CAST(home_goals AS BIGINT) AS home_goals, CAST(NULL AS DOUBLE) AS home_corners FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"match_id": "bigint", "season": "string", "home_goals": "bigint", "home_corners": "double"}
    return clean.standardise_schema(inputs.matches(spark, sf), schema)


@query(
    "preprocessor_fit_transform",
    "2.23",
    MW
    + f""", g AS (SELECT {_GAPS}, season FROM matches), t AS (SELECT median(home_shots) AS m FROM g WHERE season < 1999)
SELECT match_id, coalesce(home_shots, (SELECT m FROM t)) AS home_shots, CAST(isodow(match_date) - 1 AS INT) AS day_of_week FROM g WHERE season >= 1999""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = inputs.matches(spark, sf).selectExpr(*[c.strip() for c in _GAPS.split(",")], "season")
    g = g.withColumn("home_shots", F.col("home_shots").cast("double"))
    model = clean.fit_preprocessor(g.filter("season < 1999"), ["home_shots", "away_shots"], 60.0, _aliases(spark, sf))
    return model.transform(g.filter("season >= 1999")).select("match_id", "home_shots", "day_of_week")


@query(
    "backfill_league",
    "2.24 4.6",
    MW
    + """, c AS (SELECT team, league, count(*) AS n FROM (SELECT home_team AS team, league FROM matches UNION ALL SELECT away_team, league FROM matches) s GROUP BY ALL),
tl AS (SELECT team, league FROM c QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, league) = 1),
g AS (SELECT match_id, home_team, away_team, CASE WHEN match_id % 3 = 0 THEN league END AS league, CASE WHEN match_id % 3 = 1 AND match_id % 2 = 0 THEN 'D1' ELSE '' END AS div FROM matches)
SELECT match_id, coalesce(g.league, nullif(div, ''), CASE WHEN h.league = a.league THEN h.league END) AS league FROM g
JOIN tl h ON h.team = home_team JOIN tl a ON a.team = away_team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.aggregates import team_league_mode

    m = inputs.matches(spark, sf)
    g = m.selectExpr(
        "match_id", "home_team", "away_team", "CASE WHEN match_id % 3 = 0 THEN league END AS league",
        "CASE WHEN match_id % 3 = 1 AND match_id % 2 = 0 THEN 'D1' ELSE '' END AS div",
    )
    return clean.backfill_league(g, team_league_mode(m), "div").select("match_id", "league")


@query(
    "match_record_clean",
    "2.41",
    MW
    + f""", {_ALIAS_SQL}, r AS (SELECT match_id, CASE WHEN match_id % 6 < 5 THEN match_date END AS match_date, coalesce(h.canonical, 'Nation_' || substr(home_team, 8) || ' Fc') AS home_team,
 coalesce(a.canonical, 'Nation_' || substr(away_team, 8) || ' Fc') AS away_team, home_goals, away_goals, result
 FROM matches LEFT JOIN al h ON h.canonical = home_team LEFT JOIN al a ON a.canonical = away_team)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY match_id) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = date_texts(inputs.matches(spark, sf)).selectExpr(
        "match_id", "date_text AS match_date", "home_team || ' FC' AS home_team", "away_team || ' FC' AS away_team",
        "CAST(home_goals AS STRING) || '.0' AS home_goals", "CAST(away_goals AS STRING) AS away_goals",
    )
    return clean.clean_match_records(r, _aliases(spark, sf))


@query(
    "btts_no_odds",
    "2.44 2.35",
    MW + """SELECT match_id, round(1 / (1 - 1 / odds_over), 6) AS btts_no, round(1 / odds_h + 1 / odds_d + 1 / odds_a - 1, 6) AS margin,
 round((1 / odds_h) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS fair_h, round((1 / odds_d) / (1 / odds_h + 1 / odds_d + 1 / odds_a), 6) AS fair_d FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.functions import odds

    fair = odds.fair_probs([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])
    m = inputs.matches(spark, sf).select(
        "match_id", odds.complement_odds(F.col("odds_over")).alias("btts_no"),
        odds.margin([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")]).alias("margin"), fair[0].alias("fair_h"), fair[1].alias("fair_d"),
    )
    return rounded(m, ["match_id"], ["btts_no", "margin", "fair_h", "fair_d"])


@query(
    "clip_outliers",
    "2.46",
    MW
    + """, b AS (SELECT quantile_cont(odds_h, 0.01) l1, quantile_cont(odds_h, 0.99) h1, quantile_cont(odds_a, 0.01) l2, quantile_cont(odds_a, 0.99) h2 FROM matches)
SELECT match_id, round(least(greatest(odds_h, l1), h1), 6) AS odds_h, round(least(greatest(odds_a, l2), h2), 6) AS odds_a FROM matches, b""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).select("match_id", "odds_h", "odds_a")
    return rounded(clean.clip_outliers(m, ["odds_h", "odds_a"]), ["match_id"], ["odds_h", "odds_a"])


@query(
    "encode_labels",
    "5.9",
    MW
    + "SELECT match_id, CAST(dense_rank() OVER (ORDER BY league) - 1 AS INT) AS league_code, CAST(result = 'H' AS INT) AS result_H, CAST(result = 'D' AS INT) AS result_D FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = clean.encode_one_hot(clean.encode_labels(inputs.matches(spark, sf), "league"), "result", ["H", "D"])
    return out.select("match_id", "league_code", "result_H", "result_D")


@query(
    "row_hash",
    "2.36",
    MW + "SELECT match_id, sha256(CAST(match_id AS VARCHAR) || '|' || home_team || '|' || coalesce(CASE WHEN match_id % 2 = 0 THEN CAST(home_goals AS VARCHAR) END, chr(0)) || '|') AS h FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).withColumn("g", F.expr("CASE WHEN match_id % 2 = 0 THEN home_goals END"))
    return m.select("match_id", clean.row_hash(m, ["match_id", "home_team", "g"]).alias("h"))


@query(
    "transfer_churn",
    "2.40",
    "SELECT s_suppkey, round((s_suppkey % 7 + s_suppkey % 5) / (20 + s_suppkey % 9), 3) AS churn, (s_suppkey % 11) * 3 - s_suppkey % 13 AS net_spend FROM supplier",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.joins import latest_transfers

    s = inputs.table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS team", "s_suppkey % 7 AS signings", "s_suppkey % 5 AS departures",
        "(s_suppkey % 11) * 3 - s_suppkey % 13 AS net_spend", "20 + s_suppkey % 9 AS squad_size", "DATE'2024-01-01' AS window_date",
    )
    return latest_transfers(s).select(F.col("team").cast("bigint").alias("s_suppkey"), F.col("squad_churn").alias("churn"), "net_spend")
