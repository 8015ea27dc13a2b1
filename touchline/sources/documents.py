"""Nested feeds (events, line-ups, expected goals, odds, weather) and saved pages to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import is_placeholder_team

_NAMED = "struct<id:bigint,name:string>"
EVENT_SCHEMA = (
    f"id string, match_id bigint, period int, timestamp string, minute int, second int, team {_NAMED}, player {_NAMED}, "
    f"type {_NAMED}, sub_type {_NAMED}, possession int, location array<double>, "
    f"shot struct<type:{_NAMED},body_part:{_NAMED},outcome:{_NAMED},xg:double,end_location:array<double>,freeze_frame:array<string>>, "
    f"pass struct<length:double,angle:double,height:{_NAMED},recipient:{_NAMED},goal_assist:boolean,shot_assist:boolean,cross:boolean,through_ball:boolean>"
)
LINEUP_SCHEMA = (
    f"match_id bigint, team_name string, lineup array<struct<player_id:bigint,player_name:string,jersey_number:int,position:{_NAMED},starting:boolean>>"
)
TEAM_XG_SCHEMA = (
    "map<string,struct<title:string,history:array<struct<season:string,played:int,xG:double,xGA:double,scored:int,missed:int,"
    "wins:int,draws:int,loses:int,pts:int,npxG:double,npxGA:double>>>>"
)
_SHOT = "struct<id:string,minute:int,result:string,X:double,Y:double,xG:double,player:string,situation:string,shotType:string>"
MATCH_SHOTS_SCHEMA = f"match_id bigint, date string, h_team string, a_team string, h array<{_SHOT}>, a array<{_SHOT}>"
ODDS_FEED_SCHEMA = (
    "id string, sport_key string, sport_title string, commence_time string, home_team string, away_team string, "
    "bookmakers array<struct<key:string,title:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"
)
CUP_SCHEMA = (
    "date string, round string, `group` string, ground string, team1 string, team2 string, "
    "score struct<ft:array<int>,ht:array<int>>"
)
STATS_SCHEMA = "match_id bigint, statistics array<struct<period:string,groups:array<struct<statisticsItems:array<struct<name:string,home:string,away:string>>>>>>"
_WEATHER = (
    "struct<temp:double,feels_like:double,humidity:double,wind_speed:double,pressure:double,rain:map<string,double>,"
    "snow:map<string,double>,weather:array<struct<id:int,description:string>>>"
)
WEATHER_SCHEMA = f"match_id bigint, data array<{_WEATHER}>, current {_WEATHER}"


def parse_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of one JSON document per text value."""
    return df.select(F.from_json(text, schema).alias("_d")).select("_d.*")


def flatten_events(events: DataFrame) -> DataFrame:
    """One flat row per event with its shot and pass details."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    def at(c: str, i: int) -> Column:
        return F.get(F.col(c), i)

    shot = F.col("shot").isNotNull()
    passed = F.col("pass").isNotNull()

    def when_pass(c: Column) -> Column:
        return F.when(passed, c)

    return events.select(
        F.col("id").alias("event_id"), "match_id", F.col("period").alias("match_period"), "minute", "second",
        text("team.name").alias("team"), text("player.name").alias("player"), text("type.name").alias("type"),
        text("sub_type.name").alias("subtype"), "possession",
        at("location", 0).alias("location_x"), at("location", 1).alias("location_y"),
        F.when(shot, text("shot.type.name")).alias("shot_type"), F.when(shot, text("shot.outcome.name")).alias("shot_outcome"),
        F.col("shot.xg").alias("xg"), at("shot.end_location", 0).alias("shot_end_x"), at("shot.end_location", 1).alias("shot_end_y"),
        F.coalesce(F.size("shot.freeze_frame"), F.lit(0)).alias("freeze_frame_count"),
        F.col("pass.length").alias("pass_length"), when_pass(text("pass.height.name")).alias("pass_height"),
        when_pass(F.coalesce("pass.cross", F.lit(False))).alias("pass_cross"),
    )


def shots_only(events: DataFrame) -> DataFrame:
    """Shots of all matches; the type filter comes before anything is flattened."""
    return flatten_events(events.filter(F.col("type.name") == "Shot"))


def flatten_lineups(lineups: DataFrame) -> DataFrame:
    return lineups.select("match_id", F.col("team_name").alias("team"), F.explode("lineup").alias("p")).select(
        "match_id", "team", F.col("p.player_id").alias("player_id"), F.col("p.player_name").alias("player_name"),
        F.coalesce("p.jersey_number", F.lit(0)).alias("jersey_number"), F.coalesce("p.position.name", F.lit("")).alias("position"),
        F.coalesce("p.starting", F.lit(False)).alias("starting"), (~F.coalesce("p.starting", F.lit(False))).alias("substitute"),
    )


def team_season_xg(df: DataFrame, teams: str, season: str) -> DataFrame:
    """Season entry of each team in a map of histories; the last entry when the season is missing."""
    h = F.col("_t.history")
    wanted = F.filter(h, lambda e: e["season"] == F.lit(season))
    entry = F.coalesce(F.get(wanted, F.lit(0)), F.get(h, F.size(h) - 1))
    others = [c for c in df.columns if c != teams]
    out = df.select(*others, F.explode(F.map_values(teams)).alias("_t")).select(*others, F.col("_t.title").alias("team"), entry.alias("e"))
    return out.filter("e IS NOT NULL").select(
        *others, "team", F.col("e.season").alias("season"), F.coalesce("e.played", F.lit(0)).alias("games"),
        F.coalesce("e.xG", F.lit(0.0)).alias("xg"), F.coalesce("e.xGA", F.lit(0.0)).alias("xga"),
        F.coalesce("e.scored", F.lit(0)).alias("scored"), F.coalesce("e.missed", F.lit(0)).alias("conceded"),
        F.coalesce("e.pts", F.lit(0)).alias("points"),
    )


def match_shots(df: DataFrame) -> DataFrame:
    """Shot lists of both sides as rows."""
    sides = F.array(
        F.struct(F.lit("h").alias("side"), F.col("h_team").alias("team"), F.col("h").alias("shots")),
        F.struct(F.lit("a").alias("side"), F.col("a_team").alias("team"), F.col("a").alias("shots")),
    )
    return (
        df.select("match_id", "date", F.explode(sides).alias("s"))
        .select("match_id", "date", "s.side", "s.team", F.explode("s.shots").alias("shot"))
        .select("match_id", "date", "side", "team", F.col("shot.minute").alias("minute"), F.col("shot.player").alias("shooter"),
                F.col("shot.result").alias("result"), F.col("shot.X").alias("x"), F.col("shot.Y").alias("y"), F.col("shot.xG").alias("xg"))
    )


def odds_quotes(feed: DataFrame) -> DataFrame:
    """One row per event, bookmaker, market and outcome."""
    return (
        feed.select("id", "sport_key", "commence_time", "home_team", "away_team", F.explode("bookmakers").alias("b"))
        .select("id", "sport_key", "commence_time", "home_team", "away_team", F.col("b.title").alias("bookmaker"), F.explode("b.markets").alias("m"))
        .select("id", "sport_key", "commence_time", "home_team", "away_team", "bookmaker", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
        .select("*", F.col("o.name").alias("name"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))
        .drop("o")
    )


_EVENT = ["id", "commence_time", "home_team", "away_team"]


def _of(name: Column, price: Column) -> Column:
    return F.coalesce(F.max(F.when((F.col("market") == "h2h") & (F.col("name") == name), price)), F.lit(0.0))


def best_prices(quotes: DataFrame, bookmaker: str | None = None) -> DataFrame:
    """Highest price per outcome over bookmakers; events without home and away prices drop out."""
    q = quotes if bookmaker is None else quotes.filter(F.lower("bookmaker") == bookmaker.lower())
    price = F.col("price")
    return q.groupBy(*_EVENT).agg(
        _of(F.col("home_team"), price).alias("home_odds"), _of(F.lit("Draw"), price).alias("draw_odds"),
        _of(F.col("away_team"), price).alias("away_odds"),
    ).filter("home_odds > 0 AND away_odds > 0")


def bookmaker_prices(quotes: DataFrame) -> DataFrame:
    """One row per event and bookmaker; missing outcomes are 0."""
    price = F.col("price")
    return quotes.filter("market = 'h2h'").groupBy(*_EVENT, "bookmaker").agg(
        _of(F.col("home_team"), price).alias("home_odds"), _of(F.lit("Draw"), price).alias("draw_odds"),
        _of(F.col("away_team"), price).alias("away_odds"),
    )


def totals_prices(quotes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Best over and under price per event and goal line, for the wanted pairs in either order."""
    side = F.lower("name")
    q = quotes.filter("market = 'totals'")
    if pairs is not None:
        wanted = pairs.select(F.array_sort(F.array(F.lower("home_team"), F.lower("away_team"))).alias("_pair")).distinct()
        q = q.withColumn("_pair", F.array_sort(F.array(F.lower("home_team"), F.lower("away_team")))).join(wanted, "_pair", "left_semi")
    return q.groupBy(*_EVENT, F.coalesce("point", F.lit(2.5)).alias("totals_point")).agg(
        F.max(F.when(side == "over", F.col("price"))).alias("over_odds"), F.max(F.when(side == "under", F.col("price"))).alias("under_odds")
    ).filter("over_odds > 0")


def cup_fixtures(df: DataFrame, league: str, season: str) -> DataFrame:
    """Cup match documents as fixtures with the result of the full-time score."""
    ft, ht = F.col("score.ft"), F.col("score.ht")
    hg = F.when(F.size(ft) >= 2, F.get(ft, F.lit(0)))
    ag = F.when(F.size(ft) >= 2, F.get(ft, F.lit(1)))
    return df.select(
        F.lit(season).alias("season"), F.to_date("date").alias("match_date"), F.lit(league).alias("league"), "round", "group", "ground",
        F.col("team1").alias("home_team"), F.col("team2").alias("away_team"),
        F.when(hg > ag, "H").when(hg < ag, "A").when(hg == ag, "D").alias("result"),
        hg.alias("home_goals"), ag.alias("away_goals"),
        F.when(F.size(ht) >= 2, F.get(ht, F.lit(0))).alias("home_goals_ht"), F.when(F.size(ht) >= 2, F.get(ht, F.lit(1))).alias("away_goals_ht"),
        (is_placeholder_team(F.col("team1")) | is_placeholder_team(F.col("team2"))).alias("is_placeholder"),
    )


def group_stage(fixtures: DataFrame) -> DataFrame:
    return fixtures.filter(F.col("round").startswith("Matchday"))


def knockout_stage(fixtures: DataFrame) -> DataFrame:
    return fixtures.filter(~F.coalesce(F.col("round").startswith("Matchday"), F.lit(False)))


def completed(fixtures: DataFrame) -> DataFrame:
    return fixtures.filter("result IS NOT NULL")


def upcoming(fixtures: DataFrame) -> DataFrame:
    return fixtures.filter("result IS NULL")


def combine_cups(frames: list[DataFrame]) -> DataFrame:
    """All tournaments in one table, one row per fixture."""
    from touchline.operators.clean import smallest_of
    from touchline.sources.tabular import union_sources

    return smallest_of(union_sources(frames), ["season", "match_date", "home_team", "away_team"])


def match_statistics(df: DataFrame, names: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Named statistics of both sides as typed columns; blanks and dashes become null.

    `names` maps a statistic to (home column, away column, type). The last item of a name counts.
    """
    items = F.flatten(F.flatten(F.transform("statistics", lambda p: F.transform(p["groups"], lambda g: g["statisticsItems"]))))
    out = df.select("match_id", items.alias("items"))

    def value(stat: str, side: str, kind: str) -> Column:
        hits = F.filter("items", lambda i: F.lower(i["name"]) == stat)
        last = F.get(hits, F.size(hits) - 1)[side]
        return F.when(~F.trim(last).isin("", "-"), last).try_cast("double").cast(kind)

    cols = []
    for stat, (home, away, kind) in names.items():
        cols += [value(stat, "home", kind).alias(home), value(stat, "away", kind).alias(away)]
    return out.select("match_id", *cols)


def weather_rows(df: DataFrame, default_temp: float = 15.0) -> DataFrame:
    """Flat weather per match from the first hourly entry, else the current one."""
    w = df.withColumn("w", F.coalesce(F.get("data", F.lit(0)), F.col("current")))

    def wet(kind: str) -> Column:
        m = F.col(f"w.{kind}")
        return F.coalesce(F.nullif(F.try_element_at(m, F.lit("1h")), F.lit(0.0)), F.try_element_at(m, F.lit("3h")))

    rain = F.coalesce(F.nullif(wet("rain"), F.lit(0.0)), wet("snow"), F.lit(0.0))
    return w.select(
        "match_id", F.coalesce("w.temp", F.lit(default_temp)).alias("temperature_celsius"),
        F.coalesce("w.feels_like", F.lit(default_temp)).alias("feels_like_celsius"), F.coalesce("w.humidity", F.lit(50.0)).alias("humidity_pct"),
        F.coalesce("w.wind_speed", F.lit(0.0)).alias("wind_speed_ms"), rain.alias("precipitation_mm"),
        F.coalesce(F.get("w.weather", F.lit(0))["description"], F.lit("")).alias("condition"),
        F.coalesce("w.pressure", F.lit(1013.0)).alias("pressure_hpa"),
    )


def report_clv(df: DataFrame, text: str, file: str) -> DataFrame:
    """Closing-line metrics from JSON reports: per-model lists where present, else the report itself."""
    entry = "struct<model:string,model_name:string,name:string,avg_clv:double,clv:double,average_clv:double,positive_clv_pct:double,clv_gt_0_pct:double,clv_gt_5_pct:double,bets:int,n_bets:int,total_bets:int>"
    fields = entry[len("struct<"):-1].replace(":", " ").replace(",", ", ")
    lists = ["clv_values", "clv_per_bet", "results", "models"]
    schema = fields + ", " + ", ".join(f"{n} array<{entry}>" for n in lists)
    parsed = df.select(file, F.from_json(text, schema).alias("d"))
    nested = F.coalesce(*[F.when(F.size(F.col(f"d.{n}")) > 0, F.col(f"d.{n}")) for n in lists])
    self_row = F.struct(*[F.col(f"d.{f.split(':')[0]}").alias(f.split(":")[0]) for f in entry[len("struct<"):-1].split(",")])
    known = F.coalesce("d.avg_clv", "d.clv", "d.average_clv").isNotNull()
    rows = parsed.select(
        file, nested.isNotNull().alias("_list"),
        F.explode(F.coalesce(nested, F.when(known, F.array(self_row)), F.array().cast(f"array<{entry}>"))).alias("r"),
    )
    zero = F.lit(0.0)
    return rows.select(
        file, F.coalesce("r.model", "r.model_name", F.when(F.col("_list"), F.col("r.name")), F.when(F.col("_list"), "Unknown").otherwise("Aggregate")).alias("model"),
        F.when(F.col("_list"), F.coalesce("r.clv", "r.avg_clv", "r.average_clv", zero)).otherwise(F.coalesce("r.avg_clv", "r.clv", "r.average_clv")).alias("avg_clv"),
        F.coalesce("r.positive_clv_pct", "r.clv_gt_0_pct", zero).alias("positive_clv_pct"),
        F.coalesce("r.clv_gt_5_pct", zero).alias("clv_gt_5_pct"), F.coalesce("r.bets", "r.n_bets", "r.total_bets", F.lit(0)).alias("bets"),
    )


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of every table row of saved pages: (key, row, cell, tag, stat, text).

    Rows and cells are cut out with regular expressions in the JVM; `stat` is the cell's data-stat
    attribute and `text` its content without tags.
    """
    rows = pages.select(key, F.posexplode(F.expr(f"regexp_extract_all({html}, '(?is)<tr\\\\b[^>]*>(.*?)</tr>', 1)")).alias("row", "_tr"))
    cells = rows.select(key, "row", F.posexplode(F.expr("regexp_extract_all(_tr, '(?is)<t[dh]\\\\b[^>]*>.*?</t[dh]>', 0)")).alias("cell", "_td"))
    return cells.select(
        key, "row", "cell", F.lower(F.regexp_extract("_td", r"(?i)^<(t[dh])", 1)).alias("tag"),
        F.regexp_extract("_td", r"(?i)^<t[dh]\b[^>]*data-stat=[\"']([^\"']*)[\"']", 1).alias("stat"),
        F.trim(F.regexp_replace("_td", r"<[^>]*>", "")).alias("text"),
    )


def score_table(cells: DataFrame, key: str) -> DataFrame:
    """Match rows from data-stat cells: date, teams and a score such as 2–1; repeated fixtures once."""

    def stat(*names: str) -> Column:
        return F.max(F.when(F.col("stat").isin(*names), F.col("text")))

    rows = cells.filter("stat <> ''").groupBy(key, "row").agg(
        stat("date").alias("date"), stat("home_team", "squad_a").alias("home_team"), stat("away_team", "squad_b").alias("away_team"),
        stat("score").alias("score"),
    )
    goals = F.regexp_extract("score", r"^(\d+)\D+(\d+)$", 0)
    typed = rows.filter("home_team <> '' AND away_team <> ''").select(
        key, F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).alias("match_date"), "home_team", "away_team",
        F.when(goals != "", F.regexp_extract("score", r"^(\d+)", 1).try_cast("int")).alias("home_goals"),
        F.when(goals != "", F.regexp_extract("score", r"(\d+)$", 1).try_cast("int")).alias("away_goals"),
    )
    from touchline.operators.clean import smallest_of

    return smallest_of(typed, ["match_date", "home_team", "away_team"])


SCORE_DOCUMENT_SCHEMA = (
    "id bigint, utcDate string, status string, matchday int, stage string, `group` string, competition struct<name:string>, "
    "homeTeam struct<name:string>, awayTeam struct<name:string>, score struct<fullTime:struct<home:int,away:int>,halfTime:struct<home:int,away:int>>"
)


def score_documents(df: DataFrame) -> DataFrame:
    """Nested match documents of a results feed as fixtures; no result before both scores are known."""
    from touchline.functions.dates import season_start_year

    hg, ag = F.col("score.fullTime.home"), F.col("score.fullTime.away")
    when = F.to_date(F.try_to_timestamp("utcDate"))
    return df.select(
        F.col("id").alias("match_id"), when.alias("match_date"), season_start_year(when).alias("season"),
        F.col("competition.name").alias("league"), F.col("stage").alias("round"), F.col("status").alias("match_status"),
        F.col("homeTeam.name").alias("home_team"), F.col("awayTeam.name").alias("away_team"),
        hg.alias("home_goals"), ag.alias("away_goals"), F.col("score.halfTime.home").alias("home_goals_ht"),
        F.when(hg > ag, "H").when(hg < ag, "A").when(hg == ag, "D").otherwise("").alias("result"),
    )


# Column spellings of squad files -> schema names.
SQUAD_COLUMNS = {
    "club": "team", "squad": "team", "pos": "position", "dob": "date_of_birth", "birth": "date_of_birth", "nation": "nationality",
    "value": "market_value", "price": "market_value", "estimated_value": "market_value", "injury": "injured", "suspension": "suspended",
    "goals": "goals_scored", "matches": "appearances", "minutes": "minutes_played", "yellow": "yellow_cards", "red": "red_cards",
    "average_rating": "rating",
}
SQUAD_NUMBERS = [
    "age", "market_value", "goals_scored", "assists", "appearances", "minutes_played", "yellow_cards", "red_cards", "rating",
]


def squad_rows(df: DataFrame) -> DataFrame:
    """Squad file with alias columns as typed rows; flags default to false."""
    from touchline.functions.dates import parse_date_flexible
    from touchline.functions.text import parse_boolean

    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns]).withColumnsRenamed(SQUAD_COLUMNS)
    out = out.withColumns({c: F.col(c).try_cast("double") for c in SQUAD_NUMBERS if c in out.columns})
    if "date_of_birth" in out.columns:
        out = out.withColumn("date_of_birth", parse_date_flexible(F.col("date_of_birth")))
    for c in ("injured", "suspended"):
        out = out.withColumn(c, parse_boolean(F.col(c)) if c in out.columns else F.lit(False))
    if "position" in out.columns:
        out = out.withColumn("position", F.upper(F.trim(F.coalesce("position", F.lit("")))))
    return out


def shot_issues(shots: DataFrame) -> DataFrame:
    """Shots with a list of what is wrong with them."""
    checks = [
        F.when((F.col("xg") < 0) | (F.col("xg") > 1), "xg"),
        F.when((F.col("x") < 0) | (F.col("x") > 1), "x"),
        F.when((F.col("y") < 0) | (F.col("y") > 1), "y"),
        F.when((F.col("minute") < 0) | (F.col("minute") > 150), "minute"),
        F.when(~F.coalesce("result", F.lit("")).isin("GOAL", "MISSED", "SAVED", "BLOCKED", "OWN_GOAL", ""), "result"),
        F.when(F.coalesce("shooter", F.lit("")) == "", "shooter"),
        F.when(F.coalesce("team", F.lit("")) == "", "team"),
    ]
    return shots.withColumn("issues", F.array_compact(F.array(*checks))).filter(F.size("issues") > 0)


def match_xg_issues(matches: DataFrame) -> DataFrame:
    """Matches with implausible expected goals, goals or teams."""
    checks = [F.when((F.col(c) < 0) | (F.col(c) > 20), c) for c in ("home_xg", "away_xg")]
    checks += [F.when((F.col(c) < 0) | (F.col(c) > 30), c) for c in ("home_goals", "away_goals")]
    checks += [F.when(F.coalesce(c, F.lit("")) == "", c) for c in ("home_team", "away_team")]
    checks.append(F.when(F.col("home_team") == F.col("away_team"), "same_team"))
    return matches.withColumn("issues", F.array_compact(F.array(*checks))).filter(F.size("issues") > 0)
