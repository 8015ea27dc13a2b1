"""Enrichment joins, name resolution, keyed lookups and side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import joins
from touchline.plans import inputs
from touchline.plans.common import rounded
from touchline.plans.registry import query

MW = inputs.sql_with("matches")
TGW = inputs.sql_with("team_games")
_M = ["match_id", "match_date", "league", "home_team", "away_team"]


@query(
    "enrich_two_pass",
    "3.1",
    MW
    + """, r AS (SELECT match_date, CASE WHEN match_id % 4 = 0 THEN 'OTHER' ELSE league END AS league, home_team, away_team, home_sot AS extra_sot, attendance AS extra_att FROM matches WHERE status <> 'scheduled'),
x AS (SELECT match_date, league, home_team, away_team, min((extra_sot, extra_att)) AS v FROM r GROUP BY ALL),
b AS (SELECT match_date, home_team, away_team, min((league, extra_sot, extra_att)) AS v FROM r GROUP BY ALL)
SELECT match_id, CASE WHEN x.v IS NOT NULL THEN x.v[1] ELSE b.v[2] END AS extra_sot, CASE WHEN x.v IS NOT NULL THEN x.v[2] ELSE b.v[3] END AS extra_att
FROM matches m LEFT JOIN x USING (match_date, league, home_team, away_team) LEFT JOIN b USING (match_date, home_team, away_team)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    right = m.filter("status <> 'scheduled'").selectExpr(
        "match_date", "CASE WHEN match_id % 4 = 0 THEN 'OTHER' ELSE league END AS league", "home_team", "away_team",
        "home_sot AS extra_sot", "attendance AS extra_att",
    )
    keys = ["match_date", "league", "home_team", "away_team"]
    out = joins.enrich_two_pass(m, right, keys, ["match_date", "home_team", "away_team"], ["extra_sot", "extra_att"])
    return out.select("match_id", "extra_sot", "extra_att")


@query(
    "match_within_days",
    "3.2",
    MW
    + """, r AS (SELECT match_id AS record_id, match_date + CAST(match_id % 7 AS INT) - 3 AS d, least(home_team, away_team) AS a, greatest(home_team, away_team) AS b FROM matches)
SELECT r.record_id, max(m.match_id) AS match_id FROM r JOIN matches m ON least(m.home_team, m.away_team) = a AND greatest(m.home_team, m.away_team) = b
 AND abs(datediff('day', d, m.match_date)) <= 3 GROUP BY r.record_id HAVING count(*) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    records = m.select(
        F.col("match_id").alias("record_id"), F.expr("date_add(match_date, CAST(match_id % 7 AS INT) - 3)").alias("match_date"),
        F.concat(F.lit("FC "), F.col("away_team")).alias("home_team"), F.concat(F.col("home_team"), F.lit(" United")).alias("away_team"),
    )
    return joins.match_within_days(records, m)


# Names as other sources write them: exact, with a typing slip, with a club word, unknown.
_VARIANT = (
    "CASE s_suppkey % 5 WHEN 0 THEN lower(s_name) WHEN 1 THEN substr(s_name, 1, 3) || substr(s_name, 5) WHEN 2 THEN s_name || ' Rovers' "
    "WHEN 3 THEN 'x-' || s_name || '-zz' ELSE 'The ' || substr(s_name, 10) END"
)
_OVERRIDE = "s_suppkey % 10 = 4"


def _supplier_names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = inputs.table(spark, sf, "supplier")
    names = s.selectExpr(f"{_VARIANT} AS name")
    aliases = s.selectExpr("s_name AS alias", "s_name AS canonical")
    overrides = s.filter(_OVERRIDE).selectExpr("'THE ' || substr(s_name, 10) AS alias", "s_name AS canonical")
    return names, aliases, overrides


_RESOLVE_SQL = f"""WITH n AS (SELECT DISTINCT {_VARIANT} AS name FROM supplier), k AS (SELECT s_name AS canonical, lower(s_name) AS spelling FROM supplier),
o AS (SELECT lower('THE ' || substr(s_name, 10)) AS alias, s_name AS canonical FROM supplier WHERE {_OVERRIDE}),
f AS (SELECT name, canonical, levenshtein(lower(trim(name)), spelling) AS d FROM n JOIN k ON levenshtein(lower(trim(name)), spelling) <= 2
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(lower(trim(name)), spelling), canonical) = 1),
r AS (SELECT n.name, o.canonical AS oc, k.canonical AS ac, f.canonical AS fc, s.canonical AS sc FROM n LEFT JOIN o ON o.alias = lower(trim(n.name))
 LEFT JOIN k ON k.spelling = lower(trim(n.name)) LEFT JOIN f ON f.name = n.name LEFT JOIN k s ON n.name LIKE '% Rovers' AND s.spelling = lower(replace(n.name, ' Rovers', '')))
"""


@query(
    "resolve_names",
    "3.3 3.5 2.30",
    _RESOLVE_SQL
    + """SELECT name, coalesce(oc, ac, fc, sc, name) AS canonical, CASE WHEN oc IS NOT NULL THEN 1e0 WHEN ac IS NOT NULL THEN 0.95e0 WHEN fc IS NOT NULL THEN 0.75e0 WHEN sc IS NOT NULL THEN 0.6e0 ELSE 0e0 END AS confidence,
 CASE WHEN oc IS NOT NULL THEN 'override' WHEN ac IS NOT NULL THEN 'alias' WHEN fc IS NOT NULL THEN 'fuzzy' WHEN sc IS NOT NULL THEN 'suffix' ELSE 'fallback' END AS method FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joins.resolve_names(*_supplier_names(spark, sf))


@query(
    "resolve_columns",
    "3.4 3.23",
    _RESOLVE_SQL.replace("WITH ", MW.strip() + ", ", 1)
    + f""", s2 AS (SELECT s_suppkey, {_VARIANT} AS name FROM supplier) SELECT match_id, coalesce(oc, ac, fc, sc, r.name) AS referee_normalized,
 CASE WHEN oc IS NOT NULL THEN 'override' WHEN ac IS NOT NULL THEN 'alias' WHEN fc IS NOT NULL THEN 'fuzzy' WHEN sc IS NOT NULL THEN 'suffix' ELSE 'fallback' END AS referee_method
FROM matches JOIN s2 ON s_suppkey = referee_id JOIN r ON r.name = s2.name""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, aliases, overrides = _supplier_names(spark, sf)
    s = inputs.table(spark, sf, "supplier").selectExpr("s_suppkey AS referee_id", f"{_VARIANT} AS referee")
    m = inputs.matches(spark, sf).join(s, "referee_id")
    return joins.resolve_columns(m, ["referee"], aliases, overrides).select("match_id", "referee_normalized", "referee_method")


@query(
    "most_similar_names",
    "3.24",
    TGW
    + """, o AS (SELECT DISTINCT league, team FROM team_games), n AS (SELECT league, 'Club ' || upper(team[1]) || lower(team[2:]) AS name FROM o WHERE team NOT LIKE '% %'
 UNION SELECT league, 'Club ' || array_to_string(list_transform(string_split(team, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM o WHERE team LIKE '% %'),
s AS (SELECT n.league, name, team AS matched, 1 - levenshtein(lower(name), lower(team)) / CAST(greatest(length(name), length(team)) AS DOUBLE) AS r FROM n JOIN o USING (league))
SELECT league, name, matched, round(r, 6) AS ratio FROM s WHERE r >= 0.6e0 QUALIFY row_number() OVER (PARTITION BY league, name ORDER BY r DESC, matched) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.team_games(spark, sf)
    names = log.select("league", F.concat(F.lit("Club "), F.initcap("team")).alias("name"))
    out = joins.most_similar_names(names, log.select("league", F.col("team").alias("name")), "league")
    return rounded(out, ["league", "name", "matched"], ["ratio"])


@query(
    "resolve_keys",
    "3.6 3.29",
    MW
    + """, d AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0), h AS (SELECT DISTINCT home_team AS name FROM matches UNION SELECT DISTINCT away_team FROM matches),
t AS (SELECT * FROM d UNION ALL SELECT CAST('0x' || substr(sha256(name), 1, 15) AS BIGINT), name FROM h WHERE name NOT IN (SELECT name FROM d))
SELECT match_id, a.id AS home_team_id, b.id AS away_team_id FROM matches JOIN t a ON a.name = home_team JOIN t b ON b.name = away_team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).select("match_id", "home_team", "away_team")
    dim = inputs.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name")
    names = m.select(F.explode(F.array("home_team", "away_team")).alias("name"))
    teams = joins.get_or_create(names, dim)
    return joins.resolve_keys(m, {"home_team": teams, "away_team": teams})


@query(
    "new_rows_only",
    "3.7 3.8",
    MW
    + """, s AS (SELECT DISTINCT match_date, home_team, away_team FROM matches WHERE status = 'finished')
SELECT match_id, match_date, home_team, away_team FROM matches m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.match_date = m.match_date AND s.home_team = m.home_team AND s.away_team = m.away_team)
QUALIFY row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY match_id) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    every = inputs.matches(spark, sf)
    m = every.select("match_id", "match_date", "home_team", "away_team")
    batch = m.withColumn("_twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_twice")
    return joins.new_rows(batch, every.filter("status = 'finished'"), ["match_date", "home_team", "away_team"], "match_id")


_WEATHER = {
    "match_id": "o_orderkey", "temperature_celsius": "(o_orderkey % 45) - 10e0", "humidity_pct": "40e0 + o_orderkey % 50",
    "wind_speed_kmh": "CAST(o_orderkey % 37 AS DOUBLE)", "precipitation_mm": "(o_orderkey % 23) / 2e0",
}
_WEATHER_SQL = ", ".join(f"{e} AS {n}" for n, e in _WEATHER.items())


@query(
    "weather_features",
    "3.9",
    MW
    + f""", w AS (SELECT {_WEATHER_SQL} FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT *, least(greatest(0.4 * precipitation_mm / (SELECT max(precipitation_mm) FROM w) + 0.3 * wind_speed_kmh / (SELECT max(wind_speed_kmh) FROM w)
 + 0.3 * least(abs(temperature_celsius - 15) / 20, 1), 0), 1) AS sev FROM w)
SELECT match_id, coalesce(temperature_celsius, 15) AS temperature_celsius, coalesce(humidity_pct, 50) AS humidity_pct, coalesce(wind_speed_kmh, 10) AS wind_speed_kmh,
 round(coalesce(sev, 0), 6) AS weather_severity FROM matches LEFT JOIN s USING (match_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    w = inputs.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").selectExpr(*[f"{e} AS {n}" for n, e in _WEATHER.items()])
    out = joins.weather_features(inputs.matches(spark, sf), w)
    keep = ["match_id", "temperature_celsius", "humidity_pct", "wind_speed_kmh"]
    return rounded(out, keep, ["weather_severity"])


_CARDS = {"home_yellow": "o_orderkey % 5", "away_yellow": "o_orderkey % 6", "home_red": "o_orderkey % 2", "away_red": "CASE WHEN o_orderkey % 4 = 0 THEN 1 END"}
_CARDS_SQL = ", ".join(f"{e} AS {n}" for n, e in _CARDS.items())
_RW = "OVER (PARTITION BY referee_id ORDER BY match_date, match_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(
    "referee_features",
    "3.10",
    MW
    + f""", c AS (SELECT o_orderkey AS match_id, {_CARDS_SQL} FROM orders), j AS (SELECT m.*, c.* EXCLUDE (match_id) FROM matches m JOIN c USING (match_id))
SELECT match_id, round(coalesce(avg(home_yellow) {_RW}, 0), 6) AS ref_home_yellow_rate, round(coalesce(avg(away_yellow) {_RW}, 0), 6) AS ref_away_yellow_rate,
 round(coalesce(avg(home_yellow + away_yellow + home_red + coalesce(away_red, 0)) {_RW}, 0), 6) AS ref_card_total_avg, round(coalesce(avg(CAST(result = 'H' AS INT)) {_RW}, 0), 6) AS ref_home_win_rate FROM j""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cards = inputs.table(spark, sf, "orders").selectExpr("o_orderkey AS match_id", *[f"{e} AS {n}" for n, e in _CARDS.items()])
    out = joins.referee_features(inputs.matches(spark, sf), cards)
    return rounded(out, ["match_id"], ["ref_home_yellow_rate", "ref_away_yellow_rate", "ref_card_total_avg", "ref_home_win_rate"])


# Transfer windows: one per customer, in the customer's nation.
_TRANSFER = {
    "team": "n_name", "window_date": "CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INT) AS DATE)", "signings": "c_custkey % 7",
    "departures": "c_custkey % 5", "net_spend": "c_custkey % 90 - 40", "squad_size": "c_custkey % 4 * 10",
}
_TRANSFER_SQL = ", ".join(f"{e} AS {n}" for n, e in _TRANSFER.items())
_TR_CTE = f"tr0 AS (SELECT {_TRANSFER_SQL}, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey), tr AS (SELECT * FROM tr0 QUALIFY row_number() OVER (PARTITION BY team, window_date ORDER BY signings, departures, net_spend, squad_size) = 1)"


def _transfers(spark: SparkSession, sf: str) -> DataFrame:
    c, n = inputs.table(spark, sf, "customer"), inputs.table(spark, sf, "nation")
    exprs = {**_TRANSFER, "window_date": "date_add(DATE'1995-01-01', CAST(c_custkey * 37 % 2400 AS INT))"}
    raw = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(*[f"{e} AS {k}" for k, e in exprs.items()])
    first = F.min(F.struct("signings", "departures", "net_spend", "squad_size")).alias("r")
    return raw.groupBy("team", "window_date").agg(first).select("team", "window_date", "r.*")


@query(
    "transfer_latest_join",
    "3.11",
    MW
    + f""", {_TR_CTE}, l AS (SELECT team, signings, departures, net_spend, round((signings + departures) / CASE WHEN squad_size > 0 THEN squad_size ELSE 25 END, 3) AS churn FROM tr
 QUALIFY row_number() OVER (PARTITION BY team ORDER BY window_date DESC) = 1)
SELECT match_id, coalesce(h.signings, 0) AS h_signings, coalesce(h.net_spend, 0) AS h_net_spend, coalesce(h.churn, 0) AS h_squad_churn, coalesce(a.churn, 0) AS a_squad_churn
FROM matches LEFT JOIN l h ON h.team = home_team LEFT JOIN l a ON a.team = away_team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.squad import join_both_sides

    fill = {"signings": 0, "net_spend": 0, "squad_churn": 0.0}
    out = join_both_sides(inputs.matches(spark, sf), joins.latest_transfers(_transfers(spark, sf)), list(fill), fill)
    return out.select("match_id", "h_signings", "h_net_spend", "h_squad_churn", "a_squad_churn")


@query(
    "transfer_as_of_join",
    "3.11",
    TGW
    + f", {_TR_CTE} SELECT match_id, t.team, is_home, tr.signings, tr.net_spend FROM team_games t ASOF LEFT JOIN tr ON tr.team = t.team AND t.match_date >= tr.window_date",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.transfers_as_of(inputs.team_games(spark, sf), _transfers(spark, sf))
    return out.select("match_id", "team", "is_home", "signings", "net_spend")


@query(
    "squad_join",
    "3.12",
    MW
    + """, p AS (SELECT n_name AS team, count(*) AS squad_size, round(avg(c_custkey % 20 + 17), 1) AS avg_age FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)
SELECT match_id, h.squad_size AS h_squad_size, h.avg_age AS h_avg_age, a.squad_size AS a_squad_size, a.avg_age AS a_avg_age FROM matches
LEFT JOIN p h ON h.team = home_team LEFT JOIN p a ON a.team = away_team""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from touchline.operators.squad import join_both_sides

    per = inputs.players(spark, sf).groupBy("team").agg(F.count("*").alias("squad_size"), F.round(F.avg("age"), 1).alias("avg_age"))
    out = join_both_sides(inputs.matches(spark, sf), per, ["squad_size", "avg_age"])
    return out.select("match_id", "h_squad_size", "h_avg_age", "a_squad_size", "a_avg_age")


# Line-ups: the parts ordered from a supplier's nation on a day stand for the players that started.
_LINEUP_CTE = """lu AS (SELECT DISTINCT n_name AS team, CAST(l_shipdate AS DATE) AS match_date, l_partkey % 40 AS player FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
el AS (SELECT team, match_date, list(player) AS players FROM lu GROUP BY ALL), pv AS (SELECT *, lag(players) OVER (PARTITION BY team ORDER BY match_date) AS prev FROM el),
ro AS (SELECT team, match_date, CASE WHEN prev IS NULL THEN 0 ELSE least(len(list_filter(players, lambda x: NOT list_contains(prev, x))) / 11e0, 1) END AS rotation FROM pv)"""


@query(
    "lineup_rotation",
    "3.13",
    TGW
    + f", {_LINEUP_CTE} SELECT match_id, t.team, is_home, round(coalesce(rotation, 0), 6) AS rotation FROM team_games t ASOF LEFT JOIN ro ON ro.team = t.team AND t.match_date >= ro.match_date",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    line, s, n = (inputs.table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    lineups = line.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey")).selectExpr(
        "n_name AS team", "CAST(l_shipdate AS DATE) AS match_date", "l_partkey % 40 AS player"
    )
    return rounded(joins.rotation(inputs.team_games(spark, sf), lineups), ["match_id", "team", "is_home"], ["rotation"])


@query(
    "settle_logged_bets",
    "3.15",
    MW
    + """, b AS (SELECT DISTINCT match_date, home_team, away_team FROM matches), r AS (SELECT match_date, home_team, away_team, min(result) AS result FROM matches WHERE status = 'finished' GROUP BY ALL),
l AS (SELECT b.*, CASE WHEN length(home_team) % 2 = 0 THEN 'H' ELSE 'A' END AS pick, 2.1e0 AS odds, 10e0 AS stake FROM b)
SELECT l.match_date, l.home_team, l.away_team, CASE WHEN result IS NULL THEN 'pending' WHEN pick = result THEN 'won' ELSE 'lost' END AS status,
 round(CASE WHEN result IS NULL THEN 0 WHEN pick = result THEN stake * (odds - 1) ELSE -stake END, 6) AS profit FROM l LEFT JOIN r USING (match_date, home_team, away_team)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    bets = m.select("match_date", "home_team", "away_team").distinct().withColumns(
        {"pick": F.when(F.length("home_team") % 2 == 0, "H").otherwise("A"), "odds": F.lit(2.1), "stake": F.lit(10.0)}
    )
    results = m.filter("status = 'finished'").groupBy("match_date", "home_team", "away_team").agg(F.min("result").alias("result"))
    return rounded(joins.settle_logged(bets, results), ["match_date", "home_team", "away_team", "status"], ["profit"])


@query(
    "match_page",
    "3.20 3.18",
    MW + "SELECT match_id, match_date, home_team, away_team FROM matches ORDER BY match_date DESC, match_id DESC LIMIT 50 OFFSET 100",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joins.page_of(inputs.matches(spark, sf), limit=50, offset=100).select("match_id", "match_date", "home_team", "away_team")


@query(
    "recent_matches",
    "3.18",
    MW + "SELECT match_id, match_date FROM matches WHERE status = 'finished' AND match_date >= DATE '1997-06-01' AND match_date <= DATE '1999-06-30' ORDER BY match_date DESC, match_id DESC LIMIT 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joins.recent(inputs.matches(spark, sf), "finished", "1997-06-01", "1999-06-30").select("match_id", "match_date")


@query("name_search", "3.19", "SELECT c_name AS name FROM customer WHERE c_name ILIKE '%MER#0000000%' ORDER BY c_name LIMIT 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return joins.search_by_name(inputs.table(spark, sf, "customer").select(F.col("c_name").alias("name")), "MER#0000000")


@query(
    "soft_delete_filter",
    "3.21",
    "SELECT event_id, user_id FROM events WHERE CASE WHEN event_type = 'error' THEN ts END IS NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").withColumn("deleted_at", F.expr("CASE WHEN event_type = 'error' THEN ts END"))
    return joins.not_deleted(e).select("event_id", "user_id")


@query(
    "fill_missing_odds",
    "3.22",
    MW
    + """, t AS (SELECT match_id, match_date, home_team, away_team, CASE WHEN match_id % 3 = 0 THEN odds_over END AS odds_over, CASE WHEN match_id % 2 = 0 THEN odds_under END AS odds_under FROM matches),
s AS (SELECT match_date, home_team, away_team, max(odds_over) AS o, max(odds_under) AS u FROM matches WHERE status <> 'playing' GROUP BY ALL)
SELECT match_id, coalesce(odds_over, o) AS odds_over, coalesce(odds_under, u) AS odds_under FROM t LEFT JOIN s USING (match_date, home_team, away_team)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).select("match_id", "match_date", "home_team", "away_team", "odds_over", "odds_under", "status")
    target = m.withColumn("odds_over", F.when(F.col("match_id") % 3 == 0, F.col("odds_over"))).withColumn(
        "odds_under", F.when(F.col("match_id") % 2 == 0, F.col("odds_under"))
    )
    keys = ["match_date", "home_team", "away_team"]
    return joins.fill_missing(target, m.filter("status <> 'playing'"), keys, ["odds_over", "odds_under"]).select("match_id", "odds_over", "odds_under")


_WINDOW_SQL = """WITH a AS (SELECT c_nationkey AS team, c_custkey % 12 AS "window", count(*) AS signings, CAST(sum(c_custkey % 50) AS BIGINT) AS spent FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL),
d AS (SELECT c_nationkey AS team, c_custkey % 12 AS "window", count(*) AS departures, CAST(sum(c_custkey % 40) AS BIGINT) AS received FROM customer WHERE c_custkey % 3 = 1 GROUP BY ALL)
"""


@query(
    "transfer_windows_merge",
    "3.25",
    _WINDOW_SQL
    + """SELECT coalesce(a.team, d.team) AS team, coalesce(a."window", d."window") AS "window", coalesce(signings, 0) AS signings, coalesce(departures, 0) AS departures,
 coalesce(spent, 0) - coalesce(received, 0) AS net_spend FROM a FULL JOIN d ON a.team = d.team AND a."window" = d."window" """,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.table(spark, sf, "customer").withColumn("team", F.col("c_nationkey")).withColumn("window", F.col("c_custkey") % 12)
    a = c.filter("c_custkey % 3 = 0").groupBy("team", "window").agg(F.count("*").alias("signings"), F.sum(F.col("c_custkey") % 50).alias("spent"))
    d = c.filter("c_custkey % 3 = 1").groupBy("team", "window").agg(F.count("*").alias("departures"), F.sum(F.col("c_custkey") % 40).alias("received"))
    return joins.merge_transfer_windows(a, d).select("team", "window", "signings", "departures", "net_spend")


@query(
    "latest_pair_odds",
    "3.26 3.27",
    inputs.sql_with("matches", "books")
    + """, q AS (SELECT home_team, away_team, bookmaker, b.odds_h, b.odds_d, b.odds_a, quoted_on, match_id FROM matches JOIN books b USING (match_id)
 QUALIFY row_number() OVER (PARTITION BY home_team, away_team, bookmaker ORDER BY quoted_on DESC, match_id DESC) = 1)
SELECT home_team, away_team, bookmaker, 'H' AS outcome, odds_h AS price FROM q UNION ALL SELECT home_team, away_team, bookmaker, 'D', odds_d FROM q UNION ALL SELECT home_team, away_team, bookmaker, 'A', odds_a FROM q""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).select("match_id", "home_team", "away_team")
    q = m.join(inputs.books(spark, sf), "match_id")
    latest = joins.latest_per_key(q, ["home_team", "away_team", "bookmaker"], ["quoted_on", "match_id"])
    return latest.select(
        "home_team", "away_team", "bookmaker",
        F.expr("stack(3, 'H', odds_h, 'D', odds_d, 'A', odds_a) AS (outcome, price)"),
    )
