"""Scans, nested feeds and sinks. Files and documents are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.dates import parse_match_date
from touchline.plans import inputs
from touchline.plans.common import rounded
from touchline.plans.registry import query
from touchline.sources import documents, sinks, tabular
from touchline.sources.shared import new_path

MW = inputs.sql_with("matches")
_FIXTURE = ["match_id", "match_date", "home_team", "away_team"]


def _json(df: DataFrame, **fields: str) -> DataFrame:
    """One JSON document per row from SQL expressions."""
    return df.select(F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])).alias("doc"))


@query("csv_scan", "1.1 2.5", MW + "SELECT match_id, match_date, home_team, away_team, home_goals FROM matches")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "matches-csv")
    m = inputs.matches(spark, sf).selectExpr("match_id", "date_format(match_date, 'dd/MM/yyyy') AS date", "home_team", "away_team", "home_goals")
    m.write.option("header", True).csv(path)
    raw = tabular.read_csv(spark, path, ["match_id", "date", "home_team", "away_team", "home_goals"])
    return raw.select(
        F.col("match_id").try_cast("bigint").alias("match_id"), parse_match_date(F.col("date")).alias("match_date"), "home_team", "away_team",
        F.col("home_goals").try_cast("int").alias("home_goals"),
    )


@query(
    "parquet_scan",
    "1.2",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_returnflag",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    line = tabular.read_parquet(spark, f"{sf}/lineitem.parquet").filter("l_shipdate >= TIMESTAMP'1998-01-01'")
    return line.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("table_scan", "1.3", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark: SparkSession, sf: str) -> DataFrame:
    inputs.table(spark, sf, "events").createOrReplaceTempView("touchline_events")
    return tabular.read_table(spark, "touchline_events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "season_files_scan",
    "1.4 1.5 1.17",
    MW + "SELECT league, season, match_date, home_team, away_team, home_goals, away_goals, result FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "season-files")
    raw = inputs.matches(spark, sf).selectExpr(
        "league", "season", "date_format(match_date, 'dd/MM/yyyy') AS Date", "home_team AS HomeTeam", "away_team AS AwayTeam",
        "home_goals AS FTHG", "away_goals AS FTAG", "result AS FTR",
    )
    sinks.write_files(raw, path, "csv")
    files = tabular.read_season_files(spark, path, ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"])
    out = tabular.standardise_columns(files)
    return out.select(
        "league", F.col("season").cast("int").alias("season"), parse_match_date(F.col("date")).alias("match_date"), "home_team", "away_team",
        F.col("home_goals").cast("int").alias("home_goals"), F.col("away_goals").cast("int").alias("away_goals"), "result",
    )


@query(
    "validated_ingest",
    "1.6",
    MW
    + """SELECT match_id, CAST(match_id % 5 = 0 AS INT) + CAST(match_id % 7 = 0 AS INT) AS n_errors, CAST(match_id % 3 = 0 OR match_id % 11 = 0 AS INT) + CAST(match_id % 13 = 0 AS INT) AS n_warnings,
 match_id % 5 <> 0 AND match_id % 7 <> 0 AS valid, CASE WHEN match_id % 11 <> 0 AND match_id % 3 <> 0 THEN home_goals END AS home_goals, CASE WHEN match_id % 13 <> 0 THEN result END AS result FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.matches(spark, sf).selectExpr(
        "match_id",
        "CASE WHEN match_id % 5 = 0 THEN 'soon' ELSE date_format(match_date, 'dd/MM/yyyy') END AS match_date",
        "CASE WHEN match_id % 7 = 0 THEN '  ' ELSE home_team END AS home_team", "away_team",
        "CASE WHEN match_id % 3 = 0 THEN '-2' WHEN match_id % 11 = 0 THEN 'two' ELSE CAST(home_goals AS STRING) || '.0' END AS home_goals",
        "CASE WHEN match_id % 13 = 0 THEN 'W' ELSE lower(result) END AS result",
    )
    out = tabular.validated_ingest(raw)
    return out.select("match_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "valid", "home_goals", "result")


# Event documents from line items: the first digits of a line give its place and kind.
_EVENT_KIND = "CASE WHEN l_returnflag = 'A' THEN 'Shot' WHEN l_returnflag = 'R' THEN 'Pass' ELSE 'Foul' END"


def _event_docs(spark: SparkSession, sf: str) -> DataFrame:
    named = "named_struct('id', {i}, 'name', {n})"
    docs = _json(
        inputs.table(spark, sf, "lineitem"),
        id="CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)", match_id="l_orderkey", period="1", minute="CAST(l_quantity AS INT)",
        second="CAST(l_partkey % 60 AS INT)", team=named.format(i="l_suppkey", n="'T' || CAST(l_suppkey AS STRING)"),
        type=named.format(i="l_linenumber", n=_EVENT_KIND), possession="l_linenumber", location="array(l_quantity, l_discount * 100)",
        shot=f"CASE WHEN l_returnflag = 'A' THEN named_struct('type', {named.format(i='1', n=chr(39) + 'Open Play' + chr(39))}, 'xg', l_discount, 'end_location', array(l_quantity), 'freeze_frame', array('a', 'b')) END",
        **{"pass": "CASE WHEN l_returnflag = 'R' THEN named_struct('length', l_quantity, 'cross', l_linestatus = 'O') END"},
    )
    return documents.parse_json(docs, "doc", documents.EVENT_SCHEMA)


@query(
    "event_documents",
    "1.7",
    f"""SELECT l_orderkey AS match_id, l_linenumber AS possession, CAST(l_quantity AS INT) AS minute, 'T' || CAST(l_suppkey AS VARCHAR) AS team, {_EVENT_KIND} AS type,
 l_quantity AS location_x, round(l_discount * 100, 6) AS location_y, CASE WHEN l_returnflag = 'A' THEN l_discount END AS xg, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END AS freeze_frame_count,
 CASE WHEN l_returnflag = 'R' THEN l_quantity END AS pass_length, CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'O' END AS pass_cross FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = documents.flatten_events(_event_docs(spark, sf))
    keep = ["match_id", "possession", "minute", "team", "type", "location_x", "xg", "freeze_frame_count", "pass_length", "pass_cross"]
    return rounded(out, keep, ["location_y"])


@query(
    "shot_documents",
    "1.8",
    "SELECT l_orderkey AS match_id, count(*) AS shots, round(sum(l_discount), 6) AS xg FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    shots = documents.shots_only(_event_docs(spark, sf))
    return shots.groupBy("match_id").agg(F.count("*").alias("shots"), F.round(F.sum("xg"), 6).alias("xg"))


@query(
    "lineup_documents",
    "1.9",
    """SELECT DISTINCT l_orderkey AS match_id, 'S' || CAST(l_suppkey AS VARCHAR) AS team, l_partkey AS player_id, CASE l_linestatus WHEN 'O' THEN 'GK' ELSE 'DEF' END AS position,
 l_linenumber <= 4 AS starting, l_linenumber > 4 AS substitute FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    player = F.expr(
        "named_struct('player_id', l_partkey, 'position', named_struct('id', 1, 'name', CASE l_linestatus WHEN 'O' THEN 'GK' ELSE 'DEF' END), 'starting', l_linenumber <= 4)"
    )
    docs = (
        inputs.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(player).alias("players"))
        .select(F.to_json(F.struct(F.col("l_orderkey").alias("match_id"), F.expr("'S' || CAST(l_suppkey AS STRING)").alias("team_name"), F.col("players").alias("lineup"))).alias("doc"))
    )
    out = documents.flatten_lineups(documents.parse_json(docs, "doc", documents.LINEUP_SCHEMA))
    return out.select("match_id", "team", "player_id", "position", "starting", "substitute").distinct()


@query(
    "team_season_xg_documents",
    "1.10 4.33",
    inputs.sql_with("team_games")
    + """, h AS (SELECT league, team, season, count(*) AS played, sum(xg) AS xg, sum(xga) AS xga, sum(points) AS pts FROM team_games WHERE team <> 'NATION_3' OR season < 1998 GROUP BY ALL)
SELECT league, team, CAST(season AS VARCHAR) AS season, CAST(played AS INT) AS games, round(xg, 6) AS xg, round(xga, 6) AS xga, CAST(pts AS INT) AS points FROM h
QUALIFY row_number() OVER (PARTITION BY league, team ORDER BY CASE WHEN season = 1999 THEN 0 ELSE 1 END, season DESC) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    season = F.struct(
        F.col("season").cast("string").alias("season"), F.col("played"), F.col("xg").alias("xG"), F.col("xga").alias("xGA"), F.col("pts")
    )
    per = inputs.team_games(spark, sf).filter("team <> 'NATION_3' OR season < 1998").groupBy("league", "team", "season").agg(
        F.count("*").alias("played"), F.sum("xg").alias("xg"), F.sum("xga").alias("xga"), F.sum("points").alias("pts")
    )
    teams = per.groupBy("league", "team").agg(F.sort_array(F.collect_list(season)).alias("history"))
    doc = F.to_json(F.map_from_entries(F.collect_list(F.struct("team", F.struct(F.col("team").alias("title"), "history")))))
    docs = teams.groupBy("league").agg(doc.alias("doc")).select("league", F.from_json("doc", documents.TEAM_XG_SCHEMA).alias("teams"))
    return rounded(documents.team_season_xg(docs, "teams", "1999"), ["league", "team", "season", "games", "points"], ["xg", "xga"])


def _shot_docs(spark: SparkSession, sf: str) -> DataFrame:
    shot = F.expr(
        "named_struct('minute', CAST(l_quantity * 4 AS INT), 'result', CASE WHEN l_linestatus = 'O' THEN 'GOAL' ELSE 'WIDE' END, 'X', l_discount * 10, 'Y', l_tax * 20, 'xG', l_discount, 'player', CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'P' || CAST(l_partkey AS STRING) END)"
    )
    docs = (
        inputs.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
            F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, shot)).alias("h"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, shot)).alias("a")
        )
        .select(F.to_json(F.struct(F.col("l_orderkey").alias("match_id"), F.lit("Home").alias("h_team"), F.lit("Away").alias("a_team"), "h", "a")).alias("doc"))
    )
    return documents.match_shots(documents.parse_json(docs, "doc", documents.MATCH_SHOTS_SCHEMA))


@query(
    "match_shot_documents",
    "1.11",
    """SELECT l_orderkey AS match_id, CASE WHEN l_linenumber % 2 = 1 THEN 'h' ELSE 'a' END AS side, count(*) AS shots, count(*) FILTER (l_linestatus = 'O') AS goals, round(sum(l_discount), 6) AS xg FROM lineitem GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _shot_docs(spark, sf).groupBy("match_id", "side").agg(
        F.count("*").alias("shots"), F.count_if(F.col("result") == "GOAL").alias("goals"), F.round(F.sum("xg"), 6).alias("xg")
    )


@query(
    "shot_validation",
    "2.48",
    """SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_tax * 20 > 1 THEN 'y' END, CASE WHEN CAST(l_quantity * 4 AS INT) > 150 THEN 'minute' END, CASE WHEN l_linestatus <> 'O' THEN 'result' END,
 CASE WHEN l_partkey % 9 = 0 THEN 'shooter' END], lambda x: x IS NOT NULL)) AS issue FROM lineitem) q GROUP BY issue""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    bad = documents.shot_issues(_shot_docs(spark, sf).withColumn("x", F.lit(0.5)))
    return bad.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "match_xg_validation",
    "2.49",
    MW + "SELECT match_id, [c] AS issues FROM (SELECT match_id, CASE WHEN match_id % 8 = 0 THEN 'home_xg' WHEN match_id % 8 = 1 THEN 'away_goals' WHEN match_id % 8 = 2 THEN 'same_team' END AS c FROM matches) q WHERE c IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).withColumns(
        {
            "home_xg": F.expr("CASE WHEN match_id % 8 = 0 THEN 20.5 ELSE home_xg END"),
            "away_goals": F.expr("CASE WHEN match_id % 8 = 1 THEN -1 ELSE away_goals END"),
            "home_team": F.expr("CASE WHEN match_id % 8 = 2 THEN away_team ELSE home_team END"),
        }
    )
    return documents.match_xg_issues(m).select("match_id", "issues")


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """Odds feed documents: every bookmaker quote of a match as nested markets and outcomes."""
    m = inputs.matches(spark, sf).select("match_id", "match_date", "home_team", "away_team")
    outcome = "named_struct('name', {n}, 'price', {p}, 'point', {t})"
    h2h = ", ".join(outcome.format(n=n, p=p, t="CAST(NULL AS DOUBLE)") for n, p in (("home_team", "odds_h"), ("'Draw'", "odds_d"), ("away_team", "odds_a")))
    line = "CASE WHEN bookmaker = 'B1' THEN 3.5D ELSE 2.5D END"
    totals = ", ".join(outcome.format(n=n, p=p, t=line) for n, p in (("'Over'", "odds_d - 1"), ("'Under'", "odds_a")))
    book = F.expr(
        f"named_struct('key', lower(bookmaker), 'title', bookmaker, 'markets', array(named_struct('key', 'h2h', 'outcomes', array({h2h})), named_struct('key', 'totals', 'outcomes', array({totals}))))"
    )
    docs = (
        inputs.books(spark, sf).join(m, "match_id").groupBy("match_id", "match_date", "home_team", "away_team")
        .agg(F.collect_list(book).alias("bookmakers"))
        .select(F.to_json(F.struct(
            F.col("match_id").cast("string").alias("id"), F.lit("soccer").alias("sport_key"), F.col("match_date").cast("string").alias("commence_time"),
            "home_team", "away_team", "bookmakers")).alias("doc"))
    )
    return documents.odds_quotes(documents.parse_json(docs, "doc", documents.ODDS_FEED_SCHEMA))


_MB = inputs.sql_with("matches", "books")


@query(
    "odds_feed_best",
    "1.12 7.8",
    _MB + "SELECT match_id AS id, round(max(odds_h), 6) AS home_odds, round(max(odds_d), 6) AS draw_odds, round(max(odds_a), 6) AS away_odds FROM books GROUP BY match_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = documents.best_prices(_feed(spark, sf)).withColumn("id", F.col("id").cast("bigint"))
    return rounded(best, ["id"], ["home_odds", "draw_odds", "away_odds"])


@query(
    "odds_feed_totals",
    "1.13",
    _MB + """SELECT match_id AS id, CASE WHEN bookmaker = 'B1' THEN 3.5e0 ELSE 2.5e0 END AS totals_point, round(max(odds_d - 1), 6) AS over_odds, round(max(odds_a), 6) AS under_odds
FROM books WHERE match_id IN (SELECT match_id FROM matches WHERE home_team < away_team) OR match_id IN (SELECT match_id FROM matches WHERE league = 'ASIA') GROUP BY 1, 2
HAVING match_id IN (SELECT match_id FROM matches m WHERE (least(home_team, away_team), greatest(home_team, away_team)) IN (SELECT (home_team, away_team) FROM matches WHERE home_team < away_team))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = inputs.matches(spark, sf).filter("home_team < away_team").select("home_team", "away_team")
    totals = documents.totals_prices(_feed(spark, sf), pairs)
    ids = inputs.matches(spark, sf).filter("home_team < away_team OR league = 'ASIA'").select("match_id")
    out = totals.withColumn("id", F.col("id").cast("bigint")).join(ids, F.col("id") == F.col("match_id"), "left_semi")
    return rounded(out, ["id", "totals_point"], ["over_odds", "under_odds"])


@query(
    "odds_feed_bookmakers",
    "1.23",
    _MB + "SELECT match_id AS id, bookmaker, round(odds_h, 6) AS home_odds, round(odds_d, 6) AS draw_odds, round(odds_a, 6) AS away_odds FROM books",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    per = documents.bookmaker_prices(_feed(spark, sf)).withColumn("id", F.col("id").cast("bigint"))
    return rounded(per, ["id", "bookmaker"], ["home_odds", "draw_odds", "away_odds"])


@query(
    "closing_odds_resolve",
    "1.14",
    MW
    + """SELECT match_id, CASE WHEN match_id % 2 = 0 THEN close_h ELSE odds_h END AS closing_h, CASE WHEN match_id % 2 = 0 THEN close_a ELSE odds_a END AS closing_a,
 CASE WHEN match_id % 2 = 0 THEN 'psch' ELSE 'b365h' END AS closing_source FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf).selectExpr(
        "match_id", "CASE WHEN match_id % 2 = 0 THEN close_h END AS psch", "close_d AS pscd", "close_a AS psca",
        "odds_h AS b365h", "odds_d AS b365d", "odds_a AS b365a",
    )
    return tabular.closing_odds(m).select("match_id", "closing_h", "closing_a", "closing_source")


@query(
    "closing_pair_prices",
    "1.14",
    MW
    + """SELECT match_id, CASE WHEN match_id % 3 = 0 THEN round(odds_over + 0.1, 6) WHEN match_id % 3 = 1 THEN odds_over END AS closing_over_yes,
 CASE WHEN match_id % 3 = 0 THEN round(odds_under + 0.1, 6) WHEN match_id % 3 = 1 THEN odds_under END AS closing_over_no,
 CASE WHEN match_id % 5 > 1 THEN odds_h END AS closing_btts_yes, CASE WHEN match_id % 5 > 1 THEN odds_a END AS closing_btts_no FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Over and under from the averages, else the single bookmaker; both-score prices need both sides, and text that is no number counts as none."""
    m = inputs.matches(spark, sf).selectExpr(
        "match_id", "CASE WHEN match_id % 3 = 0 THEN round(odds_over + 0.1, 6) END AS `bbav>2.5`", "round(odds_under + 0.1, 6) AS `bbav<2.5`",
        "CASE WHEN match_id % 3 < 2 THEN odds_over END AS `b365>2.5`", "odds_under AS `b365<2.5`",
        "CASE WHEN match_id % 5 = 0 THEN 'n/a' WHEN match_id % 5 > 1 THEN CAST(odds_h AS STRING) END AS bbavbts_yes", "odds_a AS bbavbts_no",
    )
    both = tabular.closing_pair(m, "over", [("bbav>2.5", "bbav<2.5"), ("b365>2.5", "b365<2.5")])
    both = tabular.closing_pair(both, "btts", [("bbavbts_yes", "bbavbts_no")])
    return both.select("match_id", *[f"closing_{k}_{o}" for k in ("over", "btts") for o in ("yes", "no")])


def _cups(spark: SparkSession, sf: str) -> DataFrame:
    docs = _json(
        inputs.matches(spark, sf), date="CAST(match_date AS STRING)", round="CASE WHEN match_id % 4 = 0 THEN 'Final' ELSE 'Matchday 1' END",
        ground="league", team1="CASE WHEN match_id % 10 = 0 THEN 'W' || CAST(match_id AS STRING) ELSE home_team END", team2="away_team",
        score="CASE WHEN status <> 'scheduled' THEN named_struct('ft', array(home_goals, away_goals), 'ht', array(0, away_goals)) END",
    )
    return documents.cup_fixtures(documents.parse_json(docs, "doc", documents.CUP_SCHEMA), "Cup", "2026")


@query(
    "cup_documents",
    "1.15 2.42 2.43",
    MW
    + """, f AS (SELECT match_date, CASE WHEN match_id % 10 = 0 THEN 'W' || CAST(match_id AS VARCHAR) ELSE home_team END AS home_team, away_team, match_id, status <> 'scheduled' AS done, result, home_goals FROM matches)
SELECT CASE WHEN match_id % 4 = 0 THEN 'knockout' ELSE 'group' END AS stage, CASE WHEN done THEN result END AS result, match_id % 10 = 0 AS is_placeholder, count(*) AS n, CAST(sum(CASE WHEN done THEN home_goals END) AS BIGINT) AS goals
FROM f GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = _cups(spark, sf)
    staged = documents.group_stage(c).withColumn("stage", F.lit("group")).unionByName(documents.knockout_stage(c).withColumn("stage", F.lit("knockout")))
    parts = documents.completed(staged).unionByName(documents.upcoming(staged))
    return parts.groupBy("stage", "result", "is_placeholder").agg(F.count("*").alias("n"), F.sum("home_goals").alias("goals"))


@query(
    "cup_files_combined",
    "1.26 11.12",
    MW + "SELECT DISTINCT match_date, home_team, away_team FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "cups")
    m = inputs.matches(spark, sf)
    for part, rows in (("a", m.filter("season < 1999")), ("b", m.filter("season >= 1998"))):
        rows.selectExpr(
            "CAST(match_date AS STRING) AS date", "'Matchday 1' AS round", "home_team AS team1", "away_team AS team2",
            "named_struct('ft', array(home_goals, away_goals)) AS score",
        ).write.json(f"{path}/{part}")
    read = [spark.read.schema(documents.CUP_SCHEMA).json(f"{path}/{p}") for p in ("a", "b")]
    frames = [documents.cup_fixtures(d, "Cup", "all") for d in read]
    return documents.combine_cups(frames).select("match_date", "home_team", "away_team")


@query(
    "match_statistics_documents",
    "1.27",
    MW + "SELECT match_id, CASE WHEN match_id % 3 <> 0 THEN home_shots END AS home_shots, away_shots, CASE WHEN match_id % 4 <> 0 THEN round(home_xg, 6) END AS home_xg FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    item = "named_struct('name', '{n}', 'home', {h}, 'away', {a})"
    items = ", ".join(
        [
            item.format(n="Total Shots", h="CASE WHEN match_id % 3 = 0 THEN '-' ELSE CAST(home_shots AS STRING) END", a="CAST(away_shots AS STRING)"),
            item.format(n="Expected goals", h="CASE WHEN match_id % 4 = 0 THEN '' ELSE CAST(home_xg AS STRING) END", a="CAST(away_xg AS STRING)"),
        ]
    )
    docs = _json(
        inputs.matches(spark, sf), match_id="match_id",
        statistics=f"array(named_struct('period', 'ALL', 'groups', array(named_struct('statisticsItems', array({items})))))",
    )
    parsed = documents.parse_json(docs, "doc", documents.STATS_SCHEMA)
    names = {"total shots": ("home_shots", "away_shots", "int"), "expected goals": ("home_xg", "away_xg", "double")}
    return rounded(documents.match_statistics(parsed, names), ["match_id", "home_shots", "away_shots"], ["home_xg"])


@query(
    "weather_documents",
    "1.28",
    "SELECT o_orderkey AS match_id, o_orderkey % 30 * 1e0 AS temperature_celsius, CASE WHEN o_orderkey % 2 = 0 THEN 0.5e0 + o_orderkey % 3 WHEN o_orderkey % 3 = 0 THEN 2e0 ELSE 0e0 END AS precipitation_mm, 'c' || CAST(o_orderkey % 4 AS VARCHAR) AS condition, 1013e0 AS pressure_hpa FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    now = (
        "named_struct('temp', o_orderkey % 30 * 1D, 'rain', CASE WHEN o_orderkey % 2 = 0 THEN map('1h', 0.5D + o_orderkey % 3) END, "
        "'snow', CASE WHEN o_orderkey % 3 = 0 THEN map('3h', 2D) END, 'weather', array(named_struct('id', 1, 'description', 'c' || CAST(o_orderkey % 4 AS STRING))))"
    )
    docs = _json(
        inputs.table(spark, sf, "orders"), match_id="o_orderkey", data=f"CASE WHEN o_orderkey % 5 <> 0 THEN array({now}) END",
        current=f"CASE WHEN o_orderkey % 5 = 0 THEN {now} END",
    )
    out = documents.weather_rows(documents.parse_json(docs, "doc", documents.WEATHER_SCHEMA))
    return out.select("match_id", "temperature_celsius", "precipitation_mm", "condition", "pressure_hpa")


@query(
    "report_documents",
    "1.31",
    """SELECT user_id, event_type AS model, round(avg(value) + 1e-9, 4) AS avg_clv, CAST(count(*) AS INT) AS bets FROM events WHERE user_id % 2 = 0 GROUP BY ALL
UNION ALL SELECT user_id, 'Aggregate', round(avg(value) + 1e-9, 4), CAST(count(*) AS INT) FROM events WHERE user_id % 2 = 1 GROUP BY user_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events")
    per = e.filter("user_id % 2 = 0").groupBy("user_id", "event_type").agg(F.round(F.avg("value") + 1e-9, 4).alias("clv"), F.count("*").alias("n"))
    lists = per.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.col("clv"), F.col("n").alias("n_bets"))).alias("models"))
    single = e.filter("user_id % 2 = 1").groupBy("user_id").agg(F.round(F.avg("value") + 1e-9, 4).alias("clv"), F.count("*").alias("n"))
    docs = lists.select("user_id", F.to_json(F.struct("models")).alias("doc")).unionByName(
        single.select("user_id", F.to_json(F.struct(F.col("clv").alias("average_clv"), F.col("n").alias("total_bets"))).alias("doc"))
    )
    return documents.report_clv(docs, "doc", "user_id").select("user_id", "model", "avg_clv", "bets")


@query(
    "html_score_tables",
    "1.16",
    MW + "SELECT match_date, home_team, away_team, CASE WHEN max(match_id % 6) > 0 THEN min(home_goals) END AS home_goals FROM matches WHERE match_id IN (SELECT max(match_id) FROM matches GROUP BY match_date, home_team, away_team) GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    last = m.groupBy("match_date", "home_team", "away_team").agg(F.max_by(F.struct("match_id", "home_goals", "away_goals"), "match_id").alias("r"))
    row = F.expr(
        """concat('<tr class="r"><th data-stat="date" scope="row"><a href="#">', CAST(match_date AS STRING), '</a></th><td class="x" data-stat="home_team">', home_team,
        '</td>\n<td data-stat="score">', CASE WHEN r.match_id % 6 > 0 THEN concat('<b>', r.home_goals, '–', r.away_goals, '</b>') ELSE '' END, '</td><td data-stat="away_team"> ', away_team, ' </td></tr>')"""
    )
    pages = last.groupBy(F.col("match_date").alias("page")).agg(
        F.concat(F.lit('<html><table id="sched_all"><tr><th>Date</th></tr>'), F.array_join(F.collect_list(row), "\n"), F.lit("</table></html>")).alias("html")
    )
    out = documents.score_table(documents.table_rows(pages, "page", "html"), "page")
    return out.select("match_date", "home_team", "away_team", "home_goals")


@query(
    "layouts_normalised",
    "1.24 11.12",
    MW + "SELECT match_date AS date, home_team, away_team, result, CASE WHEN season < 1998 THEN 'SE1' ELSE league END AS league FROM matches",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.matches(spark, sf)
    old = m.filter("season < 1998").selectExpr("'x' AS Div", "date_format(match_date, 'dd/MM/yy') AS Date", "home_team AS HomeTeam", "away_team AS AwayTeam", "result AS FTR", "1 AS junk")
    new = m.filter("season >= 1998").selectExpr("league AS League", "season AS Season", "date_format(match_date, 'dd/MM/yyyy') AS Date", "home_team AS Home", "away_team AS Away", "lower(result) AS Res")
    both = tabular.union_sources([tabular.normalise_layout(old, "SE1", "9798").withColumn("date", F.expr("date_add(date, 0)")), tabular.normalise_layout(new, long_layout=True)])
    century = F.when(F.year("date") >= 2069, F.add_months("date", -1200)).when((F.col("league") == "SE1") & (F.year("date") > 2050), F.add_months("date", -1200)).otherwise(F.col("date"))
    return both.select(century.alias("date"), "home_team", "away_team", "result", "league")


@query(
    "odds_csv_import",
    "1.25",
    MW + "SELECT match_id, match_date, home_team, away_team, round(odds_h, 6) AS price FROM matches WHERE match_id IN (SELECT max(match_id) FROM matches GROUP BY match_date, home_team, away_team HAVING count(*) = 1)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "odds-csv")
    m = inputs.matches(spark, sf)
    single = m.groupBy("match_date", "home_team", "away_team").agg(F.max("odds_h").alias("price"), F.count("*").alias("n")).filter("n = 1")
    single.selectExpr(
        "date_format(match_date, 'dd/MM/yyyy') AS date", "home_team || ' FC' AS home", "lower(away_team) AS away", "price"
    ).write.option("header", True).csv(path)
    raw = tabular.read_csv(spark, path, ["date", "home", "away", "price"]).select(
        parse_match_date(F.col("date")).alias("match_date"), F.col("home").alias("home_team"), F.col("away").alias("away_team"), F.col("price").try_cast("double").alias("price")
    )
    aliases = inputs.table(spark, sf, "nation").selectExpr("n_name AS alias", "n_name AS canonical")
    return rounded(tabular.attach_odds(raw, m, aliases), _FIXTURE, ["price"])


@query(
    "squad_files",
    "1.29 2.7",
    "SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'GK' ELSE 'LW' END AS position, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal, 2) END AS market_value, c_custkey % 4 = 0 AS injured, FALSE AS suspended, DATE '1999-12-31' AS expected_return FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = inputs.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "CASE c_custkey % 2 WHEN 0 THEN ' gk' ELSE 'lw ' END AS Pos", "CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS `Estimated Value`",
        "CASE WHEN c_custkey % 4 = 0 THEN 'yes' ELSE '' END AS Injury", "c_name AS player", "'31/12/1999' AS expected_return",
    )
    rows = documents.squad_rows(raw)
    absent = tabular.injuries(rows.withColumn("team", F.lit(" T ")).withColumn("injury", F.col("injured").cast("string")))
    return absent.select("id", "position", F.round("market_value", 2).alias("market_value"), "injured", "suspended", "expected_return")


@query(
    "score_documents",
    "2.6 1.15",
    MW
    + """SELECT match_id, match_date, CAST(year(match_date) - CAST(month(match_date) < 8 AS INT) AS INT) AS season, league, CASE WHEN match_id % 5 <> 0 THEN home_goals END AS home_goals, CASE WHEN match_id % 5 <> 0 THEN result ELSE '' END AS result FROM matches""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = _json(
        inputs.matches(spark, sf), id="match_id", utcDate="CAST(match_date AS STRING) || 'T15:00:00Z'", competition="named_struct('name', league)",
        homeTeam="named_struct('name', home_team)", awayTeam="named_struct('name', away_team)",
        score="named_struct('fullTime', CASE WHEN match_id % 5 <> 0 THEN named_struct('home', home_goals, 'away', away_goals) END)",
    )
    out = documents.score_documents(documents.parse_json(docs, "doc", documents.SCORE_DOCUMENT_SCHEMA))
    return out.select("match_id", "match_date", "season", "league", "home_goals", "result")


@query("insert_if_absent", "1.18 3.29", MW + "SELECT match_id, league FROM matches")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "matches-table")
    m = inputs.matches(spark, sf).select("match_id", "league", "status")
    m.filter("status = 'finished'").drop("status").write.parquet(path)
    batch = m.select("match_id", F.expr("CASE WHEN status = 'finished' THEN 'changed' ELSE league END").alias("league"))
    sinks.append_if_absent(batch, path, ["match_id"], "league")
    return spark.read.parquet(path)


@query(
    "upsert_latest",
    "1.19 11.5",
    """SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").select("user_id", "event_type", "ts", "value")
    keys = ["user_id", "event_type"]
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    stored = e.filter(F.col("ts") < half)
    once = sinks.upsert(stored, stored.limit(0), keys, "ts")
    return sinks.upsert(e.filter(F.col("ts") >= half), once, keys, "ts")


@query("feature_cache", "1.20", MW + "SELECT league, count(*) AS n FROM matches GROUP BY league")
def _(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "cache")

    def build() -> DataFrame:
        return inputs.matches(spark, sf).select("match_id", "league")

    sinks.cached_features(spark, root, f"ids of {sf}", build)
    return sinks.cached_features(spark, root, f"ids of {sf}", build).groupBy("league").agg(F.count("*").alias("n"))


@query(
    "prediction_files",
    "1.21 1.30",
    inputs.sql_with("matches", "preds") + "SELECT match_id, model, round(p_h, 6) AS p_h FROM preds",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "predictions")
    sinks.save_predictions(inputs.preds(spark, sf), path)
    back = spark.read.schema("match_id bigint, model string, p_h double, p_d double, p_a double").json(path)
    return rounded(back, ["match_id", "model"], ["p_h"])


@query(
    "metric_files",
    "1.22",
    "SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "metrics")
    e = inputs.table(spark, sf, "events")
    sinks.export_metrics(e.select(F.col("event_type").alias("metric"), "ts", "value"), path)
    back = spark.read.option("header", True).schema("ts string, value double, metric string").csv(path)
    return back.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
