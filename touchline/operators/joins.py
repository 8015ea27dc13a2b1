"""Enrichment joins, name resolution and keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import team_key
from touchline.operators.clean import CLUB_WORDS
from touchline.operators.form import ORDER, as_of_values
from touchline.operators.windows import Previous, Trailing, with_asof


def enrich_two_pass(left: DataFrame, right: DataFrame, keys: list[str], fallback_keys: list[str], values: list[str]) -> DataFrame:
    """Left join on all keys; rows without any value retry on the shorter key, right rows deduplicated on it."""
    exact = right.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_exact"))
    broad = right.groupBy(*fallback_keys).agg(F.min(F.struct(*keys, *values)).alias("_broad"))
    joined = left.join(exact, keys, "left").join(broad, fallback_keys, "left")
    found = F.coalesce(*[F.col(f"_exact.{v}").cast("string") for v in values]).isNotNull()
    return joined.select(
        *left.columns, *[F.when(found, F.col(f"_exact.{v}")).otherwise(F.col(f"_broad.{v}")).alias(v) for v in values]
    )


def match_within_days(records: DataFrame, matches: DataFrame, record_id: str = "record_id", days: int = 3) -> DataFrame:
    """Match id of the only fixture of the same two teams within `days`; records with none or several drop out.

    Fixtures are counted per pair and day first, and a record looks at its 2 * days + 1 days, so a
    pair that meets often costs no more than any other.
    """

    def pair(df: DataFrame) -> DataFrame:
        return df.withColumn("_pair", F.array_sort(F.array(team_key(F.col("home_team")), team_key(F.col("away_team")))))

    daily = pair(matches).groupBy("_pair", F.col("match_date").alias("_day")).agg(
        F.count("*").alias("_n"), F.max("match_id").alias("_id")
    )
    looked = pair(records).select(
        record_id, "_pair", F.explode(F.sequence(F.date_sub("match_date", days), F.date_add("match_date", days))).alias("_day")
    )
    per_record = looked.join(daily, ["_pair", "_day"]).groupBy(record_id).agg(
        F.sum("_n").alias("candidates"), F.max("_id").alias("match_id")
    )
    return per_record.filter("candidates = 1").select(record_id, "match_id")


# ---------------------------------------------------------------- name resolution


def _shortened(name: Column, drops: int) -> Column:
    """All texts that remain after deleting up to `drops` characters; two names within that edit
    distance always share one of them."""

    def once(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    out = F.array(name)
    level = F.array(name)
    for _ in range(drops):
        level = F.array_distinct(F.flatten(F.transform(level, once)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def nearest_names(names: DataFrame, known: DataFrame, max_distance: int = 2, min_length: int = 4) -> DataFrame:
    """Closest known spelling per name within the edit distance; ties go to the canonical name in order.

    `names` has `key`; `known` has `spelling` and `canonical`. Candidates come from an equi join on
    shortened spellings, so no pairs are formed beyond those that can qualify. A name has hundreds of
    shortened spellings, which Spark's size estimate doesn't count, so neither side may be broadcast.
    """
    n = names.filter(F.length("key") >= min_length).select("key", F.explode(_shortened(F.col("key"), max_distance)).alias("_s"))
    k = known.select("spelling", "canonical", F.explode(_shortened(F.col("spelling"), max_distance)).alias("_s"))
    pairs = n.hint("merge").join(k.hint("merge"), "_s")
    # Pairs that share several spellings are not made distinct: the smallest is the same.
    scored = pairs.select("key", "canonical", F.levenshtein("key", "spelling", max_distance).alias("distance")).filter("distance >= 0")
    best = scored.groupBy("key").agg(F.min(F.struct("distance", "canonical")).alias("b"))
    return best.select("key", F.col("b.canonical").alias("canonical"), F.col("b.distance").alias("distance"))


def resolve_names(
    names: DataFrame, aliases: DataFrame, overrides: DataFrame | None = None, max_distance: int = 2, min_length: int = 4
) -> DataFrame:
    """Resolve distinct names (`name`): override 1.0, alias 0.95, edit distance 0.75, club word stripped 0.6, else 0.

    `aliases` and `overrides` have (alias, canonical). Only distinct names enter the joins.
    """

    def lookup(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.lower(F.trim("alias")).alias(f"_{tag}_key"), F.col("canonical").alias(f"_{tag}")).groupBy(f"_{tag}_key").agg(F.min(f"_{tag}").alias(f"_{tag}"))

    base = names.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    stripped = F.trim(F.regexp_replace(F.trim("name"), rf"(?i)\s+({CLUB_WORDS})|\(.*?\)", ""))
    base = base.withColumn("_short", F.when(F.lower(stripped) != F.col("key"), F.lower(stripped)))
    spellings = aliases.select(F.lower("canonical").alias("spelling"), "canonical").unionByName(
        aliases.select(F.lower(F.trim("alias")).alias("spelling"), "canonical")
    ).distinct()
    out = base
    if overrides is not None:
        out = out.join(lookup(overrides, "override"), F.col("key") == F.col("_override_key"), "left")
    else:
        out = out.withColumn("_override", F.lit(None).cast("string"))
    out = out.join(lookup(aliases, "alias"), F.col("key") == F.col("_alias_key"), "left")
    near = nearest_names(
        out.filter("_override IS NULL AND _alias IS NULL").select("key").distinct(), spellings, max_distance, min_length
    ).select(F.col("key").alias("_near_key"), F.col("canonical").alias("_near"))
    out = out.join(near, F.col("key") == F.col("_near_key"), "left")
    out = out.join(lookup(aliases, "suffix"), F.col("_short") == F.col("_suffix_key"), "left")
    steps = [("_override", 1.0, "override"), ("_alias", 0.95, "alias"), ("_near", 0.75, "fuzzy"), ("_suffix", 0.60, "suffix")]
    confidence, method = F.lit(0.0), F.lit("fallback")
    for c, score, label in reversed(steps):
        confidence = F.when(F.col(c).isNotNull(), score).otherwise(confidence)
        method = F.when(F.col(c).isNotNull(), label).otherwise(method)
    return out.select(
        "name", F.coalesce("_override", "_alias", "_near", "_suffix", F.trim("name")).alias("canonical"),
        confidence.alias("confidence"), method.alias("method"),
    )


def resolve_columns(df: DataFrame, columns: list[str], aliases: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add `<column>_normalized`, `_confidence` and `_method`; each distinct name is resolved once."""
    names = df.select(F.explode(F.array_distinct(F.array(*columns))).alias("name")).distinct()
    resolved = resolve_names(names, aliases, overrides)
    out = df
    for c in columns:
        r = resolved.select(
            F.col("name").alias(c), F.col("canonical").alias(f"{c}_normalized"),
            F.col("confidence").alias(f"{c}_confidence"), F.col("method").alias(f"{c}_method"),
        )
        out = out.join(r, c, "left")
    return out


def most_similar_names(names: DataFrame, candidates: DataFrame, group: str, threshold: float = 0.6) -> DataFrame:
    """Most similar candidate of the same group (a league's feed), when the similarity reaches the threshold (above 0).

    Similarity is 1 - edit distance / longer length, case left aside; the smaller name wins ties. Two names so similar share that part of
    the letters of the longer one, so the first letters of both in any one order share one of them; pairs meet by an equi join on these.
    """

    def letters(df: DataFrame, alias: str) -> DataFrame:
        rows = df.select(group, "name").distinct().filter(F.length("name") > 0)
        rows = rows.select(group, F.col("name").alias(alias), F.length("name").alias("_n"), F.split(F.lower("name"), "").alias("_each"))
        numbered = F.transform("_each", lambda c, i: F.xxhash64(c, F.size(F.filter(F.slice("_each", F.lit(1), i + 1), lambda o: o == c))))
        keep = F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1
        return rows.withColumn("_mixed", F.sort_array(numbered)).select(group, alias, F.explode(F.slice("_mixed", F.lit(1), keep)).alias("_letter"))

    pairs = letters(names, "name").join(letters(candidates, "_option"), [group, "_letter"]).select(group, "name", "_option").distinct()
    longer = F.greatest(F.length("name"), F.length("_option"))
    ratio = 1 - F.levenshtein(F.lower("name"), F.lower("_option")) / longer
    best = pairs.withColumn("_ratio", ratio).filter(F.col("_ratio") >= threshold).groupBy(group, "name").agg(F.min(F.struct((-F.col("_ratio")).alias("r"), F.col("_option").alias("o"))).alias("_b"))
    return best.select(group, "name", F.col("_b.o").alias("matched"), (-F.col("_b.r")).alias("ratio"))


# ---------------------------------------------------------------- keys and new rows


def key_of(name: Column) -> Column:
    """63-bit surrogate key from the name itself: the same on every run and executor."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long")


def get_or_create(names: DataFrame, dimension: DataFrame) -> DataFrame:
    """Dimension (id, name) with the names it lacked appended under new keys."""
    new = names.select("name").distinct().join(dimension, "name", "left_anti")
    return dimension.select("id", "name").unionByName(new.select(key_of(F.col("name")).alias("id"), "name"))


def resolve_keys(rows: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Replace each name column by the id of its dimension (id, name)."""
    out = rows
    for c, dim in dimensions.items():
        out = out.join(dim.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")), c, "left").drop(c)
    return out


def new_rows(batch: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch not stored yet, the first of each key only."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_r"))
    return first.select(*keys, "_r.*").join(stored.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)


def fill_missing(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Set values that are null in the target from the source row of the same key."""
    s = source.groupBy(*keys).agg(*[F.max(v).alias(f"_new_{v}") for v in values])
    out = target.join(s, keys, "left")
    return out.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in values else F.col(c) for c in target.columns])


def settle_logged(bets: DataFrame, results: DataFrame) -> DataFrame:
    """Logged bets (date, teams, pick, odds, stake) with status and profit once a result is known."""
    keys = ["match_date", "home_team", "away_team"]
    out = bets.join(results.select(*keys, "result"), keys, "left")
    won = F.col("pick") == F.col("result")
    return out.withColumn(
        "status", F.when(F.col("result").isNull(), "pending").when(won, "won").otherwise("lost")
    ).withColumn(
        "profit", F.when(F.col("result").isNull(), 0.0).when(won, F.col("stake") * (F.col("odds") - 1)).otherwise(-F.col("stake"))
    )


# ---------------------------------------------------------------- side tables


def weather_features(matches: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather per match with a severity from rain, wind and temperature; defaults where unknown."""
    rain = weather.agg(F.max("precipitation_mm")).scalar()
    wind = weather.agg(F.max("wind_speed_kmh")).scalar()

    def scaled(c: str, top: Column) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) / F.when(top > 0, top).otherwise(1.0)

    heat = F.least(F.abs(F.coalesce("temperature_celsius", F.lit(15.0)) - 15) / 20, F.lit(1.0))
    severity = 0.4 * scaled("precipitation_mm", rain) + 0.3 * scaled("wind_speed_kmh", wind) + 0.3 * heat
    w = weather.withColumn("weather_severity", F.least(F.greatest(severity, F.lit(0.0)), F.lit(1.0)))
    defaults = {
        "temperature_celsius": 15.0, "humidity_pct": 50.0, "wind_speed_kmh": 10.0, "precipitation_mm": 0.0, "weather_severity": 0.0,
    }
    return matches.join(w.select("match_id", *defaults), "match_id", "left").fillna(defaults)


def referee_features(matches: DataFrame, cards: DataFrame, window: int = 20, placeholder: float = 0.0, unit: str = "year") -> DataFrame:
    """Rolling card and home-win rates of the match's referee over earlier matches."""
    per = matches.select("match_id", "match_date", "referee_id", "result").join(cards, "match_id", "left")
    zero = F.lit(0)
    total = sum((F.coalesce(c, zero) for c in ("home_yellow", "away_yellow", "home_red", "away_red")), F.lit(0))
    feats = {
        "ref_home_yellow_rate": Trailing(F.col("home_yellow"), window),
        "ref_away_yellow_rate": Trailing(F.col("away_yellow"), window),
        "ref_card_total_avg": Trailing(total, window),
        "ref_home_win_rate": Trailing((F.col("result") == "H").cast("int"), window),
    }
    out = with_asof(per, ["referee_id"], ORDER, feats, unit)
    return matches.join(out.select("match_id", *feats), "match_id", "left").fillna(placeholder, subset=list(feats))


def latest_transfers(transfers: DataFrame) -> DataFrame:
    """Newest window per team with churn = (in + out) / squad size."""
    size = F.when(F.col("squad_size") > 0, F.col("squad_size")).otherwise(25)
    newest = transfers.groupBy("team").agg(F.max_by(F.struct("signings", "departures", "net_spend", "squad_size"), "window_date").alias("r"))
    return newest.select("team", "r.*").select(
        "team", "signings", "departures", "net_spend",
        F.round((F.col("signings") + F.col("departures")) / size, 3).alias("squad_churn"),
    )


def transfers_as_of(log: DataFrame, transfers: DataFrame, unit: str = "year") -> DataFrame:
    """Newest transfer window that closed on or before each team-game."""
    right = transfers.select("team", F.col("window_date").alias("match_date"), "signings", "departures", "net_spend")
    return as_of_values(log, right, ["team"], ["match_date"], ["signings", "departures", "net_spend"], unit, inclusive=True)


def merge_transfer_windows(arrivals: DataFrame, departures: DataFrame) -> DataFrame:
    """Full outer join of arrivals and departures per team and window."""
    both = arrivals.join(departures, ["team", "window"], "full_outer")
    zero = {c: 0 for c in ("signings", "spent", "departures", "received")}
    return both.fillna(zero).withColumn("net_spend", F.col("spent") - F.col("received"))


def rotation(log: DataFrame, lineups: DataFrame, unit: str = "year") -> DataFrame:
    """Share of the eleven changed since the team's previous line-up, as known at the match date.

    `lineups` has one row per starting player (team, match_date, player).
    """
    eleven = lineups.groupBy("team", "match_date").agg(F.sort_array(F.collect_set("player")).alias("players"))
    paired = with_asof(eleven, ["team"], ["match_date"], {"previous": Previous(F.col("players"))}, unit)
    changed = F.least(F.size(F.array_except("players", "previous")) / 11.0, F.lit(1.0))
    known = paired.select("team", "match_date", F.when(F.col("previous").isNull(), 0.0).otherwise(changed).alias("rotation"))
    return as_of_values(log, known, ["team"], ["match_date"], ["rotation"], unit, inclusive=True).fillna(0.0, subset=["rotation"])


# ---------------------------------------------------------------- lookups


def recent(matches: DataFrame, status: str | None = None, since: str | None = None, until: str | None = None, limit: int = 20, newest: bool = True) -> DataFrame:
    """Matches by status and date range in date order, the first `limit` of them."""
    out = matches
    if status:
        out = out.filter(F.col("status") == status)
    if since:
        out = out.filter(F.col("match_date") >= F.to_date(F.lit(since)))
    if until:
        out = out.filter(F.col("match_date") <= F.to_date(F.lit(until)))
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in ORDER]
    return out.orderBy(*order).limit(limit)


def head_to_head(matches: DataFrame, a: str, b: str, limit: int = 10) -> DataFrame:
    pair = ((F.col("home_team") == a) & (F.col("away_team") == b)) | ((F.col("home_team") == b) & (F.col("away_team") == a))
    return matches.filter(pair).orderBy(*[F.col(c).desc() for c in ORDER]).limit(limit)


def team_matches(matches: DataFrame, team: str, limit: int = 10) -> DataFrame:
    mine = (F.col("home_team") == team) | (F.col("away_team") == team)
    return matches.filter(mine).orderBy(*[F.col(c).desc() for c in ORDER]).limit(limit)


def page_of(matches: DataFrame, league: str | None = None, team: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    out = matches
    if league:
        out = out.filter(F.col("league") == league)
    if team:
        out = out.filter((F.col("home_team") == team) | (F.col("away_team") == team))
    return out.orderBy(*[F.col(c).desc() for c in ORDER]).offset(offset).limit(limit)


def search_by_name(names: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search."""
    return names.filter(F.lower("name").contains(text.lower())).orderBy("name").limit(limit)


def not_deleted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
