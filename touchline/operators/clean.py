"""Cleaning, typing, deduplication and the fitted preprocessor."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import dates
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.windows import Expanding, with_asof

# Match statistics whose missing values may be filled.
STAT_COLUMNS = [f"{side}_{s}" for s in ("goals", "goals_ht", "shots", "shots_target", "corners", "fouls", "yellow", "red") for side in ("home", "away")]


def calendar_features(df: DataFrame, date: str = "match_date") -> DataFrame:
    d = F.col(date)
    out = df.withColumns(dates.date_parts(d))
    return out.withColumns(
        {
            "season_start": dates.season_start_year(d),
            "week_of_season": dates.week_of_season(d),
            "is_midweek": dates.is_midweek(d),
        }
    )


def outcome_columns(df: DataFrame) -> DataFrame:
    """Class code (home win 2, draw 1, away win 0, unknown -1), goal difference, total goals and market targets."""
    hg, ag = F.col("home_goals"), F.col("away_goals")
    r = F.col("result")
    return df.withColumns(
        {
            "target": F.when(r == "H", 2).when(r == "D", 1).when(r == "A", 0).otherwise(-1),
            "goal_diff": hg - ag,
            "total_goals": hg + ag,
            "over_2_5": (hg + ag > 2.5).cast("int"),
            "btts": ((hg > 0) & (ag > 0)).cast("int"),
        }
    )


def canonical_names(df: DataFrame, columns: list[str], aliases: DataFrame) -> DataFrame:
    """Replace names found in `aliases` (alias, canonical), ignoring case and outer blanks."""
    out = df
    for c in columns:
        a = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.col("canonical").alias("_canonical"))
        out = out.withColumn("_key", F.lower(F.trim(c))).join(a, F.col("_key") == F.col("_alias"), "left")
        out = out.withColumn(c, F.coalesce("_canonical", F.trim(c))).drop("_key", "_alias", "_canonical")
    return out


def strip_club_words(name: Column) -> Column:
    """Drop bracketed parts and trailing club words, then write each word with a capital."""
    n = F.trim(F.regexp_replace(F.trim(name), r"\(.*?\)", ""))
    n = F.trim(F.regexp_replace(n, rf"(?i)\s+({CLUB_WORDS})", ""))
    return F.when(n == "", F.trim(name)).otherwise(F.initcap(n))


# Words removed from club names before they are looked up again.
CLUB_WORDS = (
    "FC|AFC|CFC|United|City|Wanderers|Rovers|Athletic|Athletique|Hotspur|Albion|County|Town|Villa|Rangers|Celtic|Lions|Stars|"
    "Barcelona|Madrid|Munich|Juventus|Milan|Inter|Roma|Napoli|PSG|Olympique|Saint-|Real|Deportivo|Club|Futbol|Futebol|"
    r"Fussball|VfL|VfB|SV|TSV|SSV|MSV|SC|1\.\s*FC|BV\s*09\s*"
)


def select_columns(
    df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None
) -> DataFrame:
    """Rename, then keep and drop columns; names that do not exist are ignored."""
    out = df.withColumnsRenamed(rename or {})
    if keep:
        out = out.select(*[c for c in keep if c in out.columns])
    return out.drop(*(drop or []))


def map_column(df: DataFrame, column: str, fn) -> DataFrame:  # noqa: ANN001 - a Column -> Column function
    """Apply a Column function to one column."""
    return df.withColumn(column, fn(F.col(column)))


@dataclass(frozen=True)
class CleanRules:
    """What `clean` does, in order: trim, cast, clip, fill, deduplicate."""

    trim: bool = True
    casts: dict[str, str] = field(default_factory=dict)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    fill: str = "none"  # none, drop, zero or mean
    fill_columns: tuple[str, ...] = ()
    unique_by: tuple[str, ...] = ()


def clean(df: DataFrame, rules: CleanRules) -> DataFrame:
    out = df
    if rules.trim:
        out = out.withColumns({n: F.trim(n) for n, t in out.dtypes if t == "string"})
    out = out.withColumns({c: F.col(c).try_cast(t) for c, t in rules.casts.items()})
    out = out.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in rules.clip.items()}
    )
    cols = list(rules.fill_columns)
    if rules.fill == "drop":
        out = out.dropna(subset=cols)
    elif rules.fill == "zero":
        out = out.fillna(0, subset=cols)
    elif rules.fill == "mean":
        means = {c: out.agg(F.avg(c)).scalar() for c in cols}
        out = out.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})
    return smallest_of(out, list(rules.unique_by)) if rules.unique_by else out


def smallest_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row that comes first in the order of its other columns (nulls first); the same row on every run."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def dedupe_most_complete(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Per key the row with the most non-null values, the newest of these on a tie."""
    others = [c for c in df.columns if c not in keys]
    filled = sum((F.col(c).isNotNull().cast("int") for c in others), F.lit(0))
    best = F.max_by(F.struct(*others), F.struct(filled, F.col(newest)))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def dedupe_latest(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Per key the newest copy; partial maxima are taken before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), newest).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def dedupe_smallest_id(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Rows whose id is the smallest of its key."""
    return df.join(df.groupBy(*keys).agg(F.min(id_column).alias(id_column)).select(id_column), id_column, "left_semi")


def sparse_columns(df: DataFrame, max_missing_pct: float) -> list[str]:
    """Columns with more than the given percentage of nulls; one aggregation, one row to the driver."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    n = row["_n"] or 1
    return [c for c in df.columns if (n - row[c]) / n * 100 > max_missing_pct]


def forward_fill(df: DataFrame, columns: list[str], keys: list[str], order: list[str], unit: str = "month") -> DataFrame:
    """Fill nulls with the last earlier value in `order`; without keys over the whole frame."""
    by = list(keys) or ["_all"]
    framed = df if keys else df.withColumn("_all", F.lit(1))
    feats = {
        f"_f_{c}": Expanding(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_value"))), "max") for c in columns
    }
    out = with_asof(framed, by, order, feats, unit)
    return out.select(
        *[F.coalesce(F.col(c), F.col(f"_f_{c}._value")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def handle_missing(
    df: DataFrame,
    strategy: str = "fill_zero",
    max_missing_pct: float = 50.0,
    order: list[str] | None = None,
    essential: tuple[str, ...] = ("match_date", "home_team", "away_team", "result"),
) -> DataFrame:
    """Drop sparse columns, then drop rows without essentials or fill statistics by zero or median.

    Team names are filled forward in `order`, and rows without a result are dropped.
    """
    out = df.drop(*sparse_columns(df, max_missing_pct))
    if strategy == "drop":
        return out.dropna(subset=[c for c in essential if c in out.columns])
    stats = [c for c in STAT_COLUMNS if c in out.columns]
    if strategy == "fill_zero":
        out = out.fillna(0, subset=stats)
    elif strategy == "fill_median":
        medians = {c: exact_quantiles(out, c, [0.5])[0] for c in stats}
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items() if m is not None})
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    teams = [c for c in ("home_team", "away_team") if c in out.columns]
    if order and teams:
        out = forward_fill(out, teams, [], order)
    return out.dropna(subset=["result"]) if "result" in out.columns else out


def standardise_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Fixed columns in fixed order and type; absent ones become null."""
    return df.select(
        *[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()]
    )


@dataclass(frozen=True)
class PreprocessorModel:
    """What `fit_preprocessor` learned; `transform` applies it to any frame of the same kind."""

    dropped: tuple[str, ...]
    medians: dict[str, float]
    aliases: DataFrame | None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(*self.dropped)
        if self.aliases is not None:
            out = canonical_names(out, [c for c in ("home_team", "away_team") if c in out.columns], self.aliases)
        out = out.fillna({c: m for c, m in self.medians.items() if c in out.columns})
        return calendar_features(out) if "match_date" in out.columns else out


def fit_preprocessor(
    train: DataFrame, numeric: list[str], max_missing_pct: float = 50.0, aliases: DataFrame | None = None
) -> PreprocessorModel:
    """Learn sparse columns and medians from training rows only."""
    dropped = tuple(sparse_columns(train, max_missing_pct))
    medians = {c: exact_quantiles(train, c, [0.5])[0] for c in numeric if c not in dropped}
    return PreprocessorModel(dropped, {c: m for c, m in medians.items() if m is not None}, aliases)


def backfill_league(matches: DataFrame, team_leagues: DataFrame, div: str | None = None) -> DataFrame:
    """Fill a missing league from the division, else from the league both (or one) of the teams belong to.

    When the two teams point to different leagues the value stays null.
    """
    base = matches.withColumn("league", F.coalesce("league", F.nullif(F.col(div), F.lit("")))) if div else matches
    for side in ("home", "away"):
        named = team_leagues.select(F.lower(F.trim("team")).alias(f"_{side}_key"), F.col("league").alias(f"_{side}_league"))
        base = base.join(named, F.lower(F.trim(f"{side}_team")) == F.col(f"_{side}_key"), "left").drop(f"_{side}_key")
    h, a = F.col("_home_league"), F.col("_away_league")
    guess = F.when(h.isNull(), a).when(a.isNull() | (h == a), h)
    return base.withColumn("league", F.coalesce("league", guess)).drop("_home_league", "_away_league")


def clean_match_records(df: DataFrame, known_names: DataFrame) -> DataFrame:
    """Typed match records: dates, goals, result from the score, names, one row per fixture."""
    out = df.withColumns(
        {
            "match_date": dates.parse_date_flexible(F.col("match_date")),
            "home_goals": F.col("home_goals").try_cast("double").cast("int"),
            "away_goals": F.col("away_goals").try_cast("double").cast("int"),
        }
    )
    diff = F.col("home_goals") - F.col("away_goals")
    out = out.withColumn("result", F.when(diff > 0, "H").when(diff < 0, "A").when(diff == 0, "D"))
    for c in ("home_team", "away_team"):
        known = known_names.select(F.lower(F.trim("alias")).alias("_alias"), F.col("canonical").alias("_canonical"))
        out = out.join(known, F.lower(F.trim(c)) == F.col("_alias"), "left")
        out = out.withColumn(c, F.coalesce("_canonical", F.initcap(F.trim(c)))).drop("_alias", "_canonical")
    return dedupe_smallest_first(out, ["match_date", "home_team", "away_team"], "match_id")


def dedupe_smallest_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the row with the smallest `order` value, null keys included."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def clip_outliers(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each column to its own percentiles; nulls become 0 afterwards."""
    out = df
    for c in columns:
        lo, hi = exact_quantiles(df, c, [low, high])
        if lo is not None:
            out = out.withColumn(c, F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
    return out.fillna(0, subset=columns)


# Columns that would leak the result into a feature matrix.
LEAKY_COLUMNS = [
    "result", "target", "home_goals", "away_goals", "goal_diff", "total_goals", "home_goals_ht", "away_goals_ht", "result_ht",
]


def drop_leaky_columns(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*LEAKY_COLUMNS, *more)


def encode_labels(df: DataFrame, column: str) -> DataFrame:
    """Category codes in alphabetical order, from the distinct values only."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(f"{column}_code"))
    return df.join(ranked, column, "left")


def encode_one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories})


def sample_weights(df: DataFrame, date: str, halflife_days: float) -> DataFrame:
    """Recency weights against the day after the newest row."""
    ref = df.agg(F.date_add(F.max(date), 1)).scalar()
    return df.withColumn("weight", recency_weight(F.col(date), ref, halflife_days))


def recency_weight(date: Column, reference: Column, halflife_days: float) -> Column:
    """exp(-ln 2 * days / halflife); 1 when the halflife is not positive."""
    if halflife_days <= 0:
        return F.lit(1.0)
    return F.exp(F.lit(-0.6931471805599453) * F.greatest(F.datediff(reference, date), F.lit(0)) / F.lit(float(halflife_days)))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over the values as text; nulls count as a zero byte."""
    parts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("\0")), F.lit("|")) for c in columns]
    return F.sha2(F.concat(*parts), 256)
