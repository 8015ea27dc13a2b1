"""Row checks, feature checks, rules and record validation."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.dates import parse_date_flexible
from touchline.operators.windows import Previous, with_asof

# Column name fragments with their lowest and highest plausible value.
STAT_BOUNDS: list[tuple[str, float, float | None]] = [
    ("possession", 0, 100), ("shots", 0, None), ("corners", 0, None), ("fouls", 0, None), ("yellow", 0, None), ("red", 0, None),
    ("offsides", 0, None), ("attendance", 0, 200000),
]
# Fragments that mark a column as odds.
ODDS_FRAGMENTS = ["odds", "bbav", "b365", "psh", "psd", "psa"]
FINISHED = ["finished", "completed", "played"]


def _violations(df: DataFrame, check: str, row_id: str, tests: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per broken test: (check, row_id, field, value, message); all tests in one projection."""
    items = [
        F.when(test, F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value"), message.alias("message")))
        for field, test, message in tests
    ]
    out = df.select(F.col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*items))).alias("_v"))
    return out.select(F.lit(check).alias("check"), "row_id", "_v.*")


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def check_duplicate_matches(df: DataFrame, row_id: str) -> DataFrame:
    """Every row after the first of the same teams (case ignored) and date."""
    key = F.concat_ws("|", F.lower("home_team"), F.lower("away_team"), F.col("match_date").cast("string"))
    keyed = df.select(F.col(row_id).alias("row_id"), key.alias("value"))
    first = keyed.groupBy("value").agg(F.min("row_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = keyed.join(first, "value").filter("row_id <> _first")
    return again.select(
        F.lit("duplicate_matches").alias("check"), "row_id", F.lit("match").alias("field"), "value",
        F.concat(F.lit("same match as row "), F.col("_first").cast("string")).alias("message"),
    )


def check_duplicate_ids(df: DataFrame, row_id: str, id_column: str) -> DataFrame:
    """Ids that occur more than once, on every row but the first."""
    first = df.groupBy(id_column).agg(F.min(row_id).alias("_first"), F.count("*").alias("_n")).filter(f"_n > 1 AND {id_column} IS NOT NULL")
    again = df.select(row_id, id_column).join(first, id_column).filter(F.col(row_id) != F.col("_first"))
    return again.select(
        F.lit("duplicate_ids").alias("check"), F.col(row_id).alias("row_id"), F.lit(id_column).alias("field"),
        F.col(id_column).cast("string").alias("value"), F.lit("id occurs more than once").alias("message"),
    )


def check_invalid_dates(df: DataFrame, row_id: str, today: str, date: str = "match_date", years_ahead: int = 3) -> DataFrame:
    parsed = parse_date_flexible(F.col(date))
    missing = F.col(date).isNull() | (F.trim(date) == "")
    late = parsed > F.add_months(F.to_date(F.lit(today)), 12 * years_ahead)
    return _violations(
        df, "invalid_dates", row_id,
        [
            (date, missing, F.lit("date is missing")),
            (date, ~missing & parsed.isNull(), F.lit("date cannot be read")),
            (date, late, F.lit("date is too far ahead")),
        ],
    )


def check_invalid_odds(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """Odds of 1 or less and values that are no numbers, in columns named like odds."""
    cols = columns or [c for c in df.columns if any(f in c.lower() for f in ODDS_FRAGMENTS)]
    tests = []
    for c in cols:
        tests.append((c, _number(c) <= 1, F.lit("odds must be above 1")))
        tests.append((c, F.col(c).isNotNull() & _number(c).isNull(), F.lit("odds are not a number")))
    return _violations(df, "invalid_odds", row_id, tests)


def check_missing_goals(df: DataFrame, row_id: str) -> DataFrame:
    done = F.lower(F.trim("status")).isin(FINISHED) | F.upper(F.trim("result")).isin("H", "D", "A")
    done = F.coalesce(done, F.lit(False))

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")

    return _violations(df, "missing_goals", row_id, [("home_goals", done & (blank("home_goals") | blank("away_goals")), F.lit("finished match without goals"))])


def check_missing_teams(df: DataFrame, row_id: str) -> DataFrame:
    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(c) == "")

    same = ~blank("home_team") & (F.lower(F.trim("home_team")) == F.lower(F.trim("away_team")))
    return _violations(
        df, "missing_teams", row_id,
        [
            ("home_team", blank("home_team"), F.lit("home team is missing")),
            ("away_team", blank("away_team"), F.lit("away team is missing")),
            ("away_team", same, F.lit("home and away team are the same")),
        ],
    )


def check_incorrect_leagues(df: DataFrame, row_id: str, allowed: list[str] | None = None) -> DataFrame:
    blank = F.col("league").isNull() | (F.trim("league") == "")
    tests = [("league", blank, F.lit("league is missing"))]
    if allowed:
        tests.append(("league", ~blank & ~F.col("league").isin(allowed), F.lit("league is not known")))
    return _violations(df, "incorrect_leagues", row_id, tests)


def check_invalid_statistics(df: DataFrame, row_id: str) -> DataFrame:
    """Statistics outside their plausible range, by column name."""
    tests = []
    for c in df.columns:
        for fragment, lo, hi in STAT_BOUNDS:
            if fragment in c.lower():
                tests.append((c, _number(c) < lo, F.lit("value is too low")))
                if hi is not None:
                    tests.append((c, _number(c) > hi, F.lit("value is too high")))
    return _violations(df, "invalid_statistics", row_id, tests)


def check_impossible_scores(df: DataFrame, row_id: str, highest: int = 20) -> DataFrame:
    tests = []
    for c in ("home_goals", "away_goals"):
        n = F.col(c).try_cast("int")
        tests += [
            (c, n < 0, F.lit("goals are negative")),
            (c, n > highest, F.lit("goals are too many")),
            (c, F.col(c).isNotNull() & n.isNull(), F.lit("goals are not whole")),
        ]
    h, a = F.col("home_goals").try_cast("int"), F.col("away_goals").try_cast("int")
    expected = F.when(h > a, "H").when(a > h, "A").when(h == a, "D")
    tests.append(("result", (F.trim("result") != "") & (F.upper("result") != expected), F.lit("result does not follow from the score")))
    return _violations(df, "impossible_scores", row_id, tests)


def all_row_checks(df: DataFrame, row_id: str, today: str, leagues: list[str] | None = None) -> DataFrame:
    parts = [
        check_duplicate_matches(df, row_id), check_invalid_dates(df, row_id, today), check_invalid_odds(df, row_id), check_missing_goals(df, row_id),
        check_missing_teams(df, row_id), check_incorrect_leagues(df, row_id, leagues), check_invalid_statistics(df, row_id), check_impossible_scores(df, row_id),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summarise(violations: DataFrame) -> DataFrame:
    """Violations per check and field."""
    return violations.groupBy("check", "field").agg(F.count("*").alias("violations"), F.countDistinct("row_id").alias("rows"))


# ---------------------------------------------------------------- feature checks


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, NaN and infinite values, minimum, maximum, mean and variance; one aggregation."""
    items = []
    for c in columns:
        v = F.col(c).cast("double")
        finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        items.append(
            F.struct(
                F.lit(c).alias("feature"), F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"),
                F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinite"),
                F.min(finite).alias("lowest"), F.max(finite).alias("highest"), F.avg(finite).alias("mean"), F.var_samp(finite).alias("variance"),
            )
        )
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_f")).select("_f.*")


def check_features(df: DataFrame, columns: list[str], max_missing: float = 0.2, min_variance: float = 1e-3) -> DataFrame:
    """Constant, sparse, infinite, NaN and low-variance features."""
    s = feature_statistics(df, columns)
    missing = (F.col("nulls") + F.col("nans")) / F.col("n")
    flags = F.array(
        F.when(F.col("lowest").isNull() | (F.col("lowest") == F.col("highest")), "constant_features"),
        F.when(missing > max_missing, "missing_values"),
        F.when(F.col("infinite") > 0, "infinite_values"),
        F.when(F.col("nans") > 0, "nan_values"),
        F.when(F.col("variance") < min_variance, "low_variance"),
    )
    return s.select("feature", F.explode(F.array_compact(flags)).alias("check"))


def check_ranges(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values below and above the bounds; names may hold `*`."""
    cols = {c: b for pattern, b in bounds.items() for c in fnmatch.filter(df.columns, pattern)}
    items = [
        F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c) < lo).alias("below"), F.count_if(F.col(c) > hi).alias("above"))
        for c, (lo, hi) in cols.items()
    ]
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_f")).select("_f.*").filter("below + above > 0")


def check_time_order(df: DataFrame, date: str, ingest_order: str, group: str) -> DataFrame:
    """Rows dated before (leak) or on the same day as the row ingested just before, per group."""
    block = F.floor(F.col(ingest_order) / 1_000_000)
    out = with_asof(df.select(group, date, ingest_order), [group], [ingest_order], {"_prev": Previous(F.col(date))}, block=block)
    return out.groupBy(group).agg(
        F.count_if(F.col(date) < F.col("_prev")).alias("out_of_order"), F.count_if(F.col(date) == F.col("_prev")).alias("same_day")
    )


def check_duplicate_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns with equal values in every row, nulls included; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.every(F.col(a).eqNullSafe(F.col(b))).alias("same")) for a, b in pairs]
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_f")).select("_f.a", "_f.b", "_f.same").filter("same").drop("same")


# ---------------------------------------------------------------- rules and records


def rule_not_empty(df: DataFrame) -> DataFrame:
    return df.agg((F.count("*") > 0).alias("passed"))


def rule_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count of required columns; a column that does not exist counts as null everywhere."""
    items = [
        F.struct(F.lit(c).alias("column"), (F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias("nulls")) for c in columns
    ]
    out = df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_f")).select("_f.*")
    return out.withColumn("passed", F.col("nulls") == 0)


def rule_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return n.agg(F.count_if(F.col("_n") > 1).alias("repeated_keys")).withColumn("passed", F.col("repeated_keys") == 0)


def validate_schema(df: DataFrame, schema: dict[str, tuple[str, bool]]) -> DataFrame:
    """Per column: values that do not cast to the type, and nulls where none are allowed."""
    items = []
    for c, (kind, nullable) in schema.items():
        present = c in df.columns
        bad = F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()) if present else F.lit(0).cast("long")
        nulls = (F.count_if(F.col(c).isNull()) if present else F.count("*")) if not nullable else F.lit(0).cast("long")
        items.append(F.struct(F.lit(c).alias("column"), F.lit(present).alias("present"), bad.alias("bad_type"), nulls.alias("bad_null")))
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_f")).select("_f.*")


def batch_summary(results: DataFrame) -> DataFrame:
    """Passed and failed counts per rule over (rule, passed) rows."""
    return results.groupBy("rule").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def validate_records(df: DataFrame, today: str) -> DataFrame:
    """Per league: records, those with fatal errors, those that passed, and warnings."""
    parsed = parse_date_flexible(F.col("match_date"))
    h, a = _number("home_goals"), _number("away_goals")

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(c) == "")

    fatal = [
        blank("home_team"), blank("away_team"), blank("match_date"), ~blank("match_date") & parsed.isNull(), h < 0, a < 0,
        ~blank("result") & ~F.col("result").isin("H", "D", "A"),
        F.length(F.trim("home_team")) < 2, F.length(F.trim("away_team")) < 2,
    ]
    warn = [parsed > F.to_date(F.lit(today)), h > 50, a > 50]
    for c in [c for c in df.columns if c.startswith("odds_")]:
        warn += [_number(c) < 1, _number(c) > 100]
    warn += [(F.col("result") == "H") & (h <= a), (F.col("result") == "A") & (a <= h), (F.col("result") == "D") & (h != a)]

    def count(tests: list[Column]) -> Column:
        total = F.lit(0)
        for t in tests:
            total = total + F.coalesce(t, F.lit(False)).cast("int")
        return total

    out = df.withColumns({"_fatal": count(fatal), "_warn": count(warn)})
    return out.groupBy(F.coalesce("league", F.lit("unknown")).alias("league")).agg(
        F.count("*").alias("total"), F.count_if(F.col("_fatal") > 0).alias("fatal"), F.count_if(F.col("_fatal") == 0).alias("passed"), F.sum("_warn").alias("warnings")
    )


def validate_clean(df: DataFrame) -> DataFrame:
    """One row on a cleaned match table: missing keys, bad targets, wrong differences, repeated fixtures."""
    wrong = F.col("goal_diff") != F.col("home_goals") - F.col("away_goals")
    core = df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("home_team").isNull() | F.col("away_team").isNull() | F.col("match_date").isNull()).alias("missing_keys"),
        F.count_if(~F.col("target").isin(-1, 0, 1, 2)).alias("bad_target"), F.count_if(wrong).alias("bad_goal_diff"),
        F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
    )
    fixtures = df.groupBy("match_date", "home_team", "away_team").agg(F.count("*").alias("n"))
    return core.withColumn("duplicates", fixtures.agg(F.sum(F.col("n") - 1)).scalar())
