"""Match and odds tables from CSV, parquet and databases, brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.dates import parse_match_date
from touchline.functions.text import team_key

# Column names of season files -> schema names.
SEASON_FILE_COLUMNS = {
    "div": "league", "hometeam": "home_team", "awayteam": "away_team", "fthg": "home_goals", "ftag": "away_goals",
    "ftr": "result", "hthg": "home_goals_ht", "htag": "away_goals_ht", "htr": "result_ht", "hs": "home_shots",
    "as": "away_shots", "hst": "home_shots_target", "ast": "away_shots_target", "hc": "home_corners", "ac": "away_corners",
    "hf": "home_fouls", "af": "away_fouls", "hy": "home_yellow", "ay": "away_yellow", "hr": "home_red", "ar": "away_red",
}
# Column names of the multi-season layout.
LONG_FILE_COLUMNS = {"home": "home_team", "away": "away_team", "hg": "home_goals", "ag": "away_goals", "res": "result"}

# Closing 1X2 columns by bookmaker, in order of preference.
CLOSING_TRIPLES = [
    ("psch", "pscd", "psca"), ("b365ch", "b365cd", "b365ca"), ("bbavh", "bbavd", "bbava"), ("avgch", "avgcd", "avgca"),
    ("psh", "psd", "psa"), ("b365h", "b365d", "b365a"),
]

INT_COLUMNS = ["home_goals", "away_goals", "home_goals_ht", "away_goals_ht", "home_shots", "away_shots"]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """CSV with a header, every column as text; typing happens in a later, checked step."""
    reader = spark.read.option("header", True).options(**options)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str, url: str | None = None, partition_column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 16, **options: str) -> DataFrame:
    """Catalog table, or a database table read in parallel ranges of `partition_column`."""
    if url is None:
        return spark.table(name)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return reader.load()


def read_season_files(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """All files under `league=*/season=*`; league and season come from the folders."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(
        ", ".join(f"`{c}` string" for c in columns)
    )
    return raw.option("basePath", root).csv(f"{root}/league=*/season=*").withColumn("source_file", F.col("_metadata.file_name"))


def standardise_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Lower-case trimmed names, mapped to the schema."""
    lowered = df.toDF(*[c.strip().lower() for c in df.columns])
    return lowered.withColumnsRenamed(mapping or SEASON_FILE_COLUMNS)


def normalise_layout(df: DataFrame, league: str | None = None, season: str | None = None, long_layout: bool = False) -> DataFrame:
    """Season files and multi-season files to one schema, with dates and results typed."""
    mapping = LONG_FILE_COLUMNS if long_layout else SEASON_FILE_COLUMNS
    out = standardise_columns(df, mapping)
    keep = {"date", *mapping.values(), *(["season", "country", "league"] if long_layout else [])}
    keep |= {c for c in out.columns if c.startswith("bb")}
    out = out.select(*[c for c in out.columns if c in keep])
    if league is not None:
        out = out.withColumn("league", F.lit(league))
    if season is not None and "season" not in out.columns:
        out = out.withColumn("season", F.lit(season))
    return out.withColumns(
        {"date": parse_match_date(F.col("date")), "result": F.substring(F.upper(F.col("result").cast("string")), 1, 1)}
    )


def validated_ingest(df: DataFrame, date: str = "match_date") -> DataFrame:
    """Typed rows with an `errors` and a `warnings` array instead of failing reads."""

    def blank(c: Column) -> Column:
        return c.isNull() | (F.trim(c) == "")

    parsed = parse_match_date(F.col(date))
    errors: list[Column] = [F.when(F.col(date).isNotNull() & parsed.isNull(), F.concat(F.lit("Invalid date: "), F.col(date)))]
    errors += [F.when(blank(F.col(c)), F.lit(f"Missing {c}")) for c in ("home_team", "away_team")]
    warnings: list[Column] = []
    typed: dict[str, Column] = {date: parsed}
    for c in [c for c in INT_COLUMNS if c in df.columns]:
        number = F.col(c).try_cast("double")
        whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int")
        warnings.append(F.when(F.col(c).isNotNull() & number.isNull(), F.concat(F.lit(f"Could not coerce {c}: "), F.col(c))))
        if c.endswith("goals"):
            warnings.append(F.when(whole < 0, F.concat(F.lit(f"Negative {c}: "), whole.cast("string"))))
            whole = F.when(whole >= 0, whole)
        typed[c] = whole
    r = F.upper(F.trim("result"))
    typed["result"] = F.when(r.isin("H", "D", "A"), r)
    warnings.append(F.when(~blank(F.col("result")) & ~r.isin("H", "D", "A"), F.concat(F.lit("Unrecognised result: "), F.col("result"))))
    for c in ("home_team", "away_team"):
        typed[c] = F.coalesce(F.trim(c), F.lit(""))
    out = df.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumns(typed).withColumn("valid", F.size("errors") == 0)


def closing_odds(df: DataFrame, triples: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Closing odds from the first bookmaker whose three columns exist and are filled in the row; null where there is none."""
    have = set(df.columns)
    usable = [t for t in triples or CLOSING_TRIPLES if set(t) <= have]
    if not usable:
        return df.select("*", *[F.lit(None).cast("double").alias(c) for c in ("closing_h", "closing_d", "closing_a")], F.lit(None).cast("string").alias("closing_source"))
    picks = [
        F.when(
            F.col(h).isNotNull() & F.col(d).isNotNull() & F.col(a).isNotNull(),
            F.struct(
                F.col(h).try_cast("double").alias("closing_h"), F.col(d).try_cast("double").alias("closing_d"),
                F.col(a).try_cast("double").alias("closing_a"), F.lit(h).alias("closing_source"),
            ),
        )
        for h, d, a in usable
    ]
    return df.withColumn("_c", F.coalesce(*picks)).select(*df.columns, "_c.*")


def closing_pair(df: DataFrame, market: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Closing prices of a market with two outcomes (both score, over and under) from the first pair of columns that both hold numbers in the row."""
    names = (f"closing_{market}_yes", f"closing_{market}_no")
    found = {c: F.col(_quoted(c)).try_cast("double") for pair in pairs if set(pair) <= set(df.columns) for c in pair}
    picks = [F.when(found[y].isNotNull() & found[n].isNotNull(), F.struct(found[y], found[n])) for y, n in pairs if y in found and n in found]
    kept = [F.col(_quoted(c)) for c in df.columns if c not in names]
    if not picks:
        return df.select(*kept, *[F.lit(None).cast("double").alias(c) for c in names])
    first = F.coalesce(*[p.cast("struct<yes:double,no:double>") for p in picks])
    return df.select(*kept, first["yes"].alias(names[0]), first["no"].alias(names[1]))


def _quoted(name: str) -> str:
    """Column name that may hold dots, as in `bbav>2.5`."""
    return "`" + name.replace("`", "``") + "`"


def attach_odds(odds: DataFrame, matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """Odds rows of another source attached to matches by date and mapped team names."""
    out = odds
    for c in ("home_team", "away_team"):
        a = aliases.select(team_key(F.col("alias")).alias("_alias"), F.col("canonical").alias(f"_{c}")).groupBy("_alias").agg(F.min(f"_{c}").alias(f"_{c}"))
        out = out.join(a, team_key(F.col(c)) == F.col("_alias"), "left").withColumn(c, F.coalesce(f"_{c}", F.trim(c))).drop("_alias", f"_{c}")
    return out.join(matches.select("match_id", "match_date", "home_team", "away_team"), ["match_date", "home_team", "away_team"])


def injuries(df: DataFrame) -> DataFrame:
    """Trimmed injury list with a typed return date."""
    text = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("team", "player", "injury")}
    return df.withColumns(text).withColumn("expected_return", parse_match_date(F.col("expected_return")))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate sources with differing columns; absent ones become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
