"""Dataset profiles, drift between datasets, and monitoring metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.aggregates import null_counts, shares
from touchline.operators.form import team_game_log
from touchline.operators.quantiles import exact_quantiles

EPS = 1e-6


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


# ---------------------------------------------------------------- profile sections


def column_summary(df: DataFrame) -> DataFrame:
    """Type, nulls, distinct values, minimum and maximum of every column; one aggregation."""
    items = [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct"),
            F.min(c).cast("string").alias("lowest"), F.max(c).cast("string").alias("highest"),
        )
        for c, t in df.dtypes
    ]
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*")


def top_missing(df: DataFrame, limit: int = 20) -> DataFrame:
    return null_counts(df).orderBy(F.col("nulls").desc(), "column").limit(limit)


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier full row. Rows are compared by value, hashed to spread them evenly."""
    n = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    out = n.agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("pct", F.col("duplicates") / F.greatest("rows", F.lit(1)) * 100)


def goal_moments(matches: DataFrame) -> DataFrame:
    """Moments of goals by side and in total."""
    items = [("home", F.col("home_goals")), ("away", F.col("away_goals")), ("total", F.col("home_goals") + F.col("away_goals"))]
    cells = [
        F.struct(F.lit(n).alias("side"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.median(v).alias("median"))
        for n, v in items
    ]
    return matches.agg(F.array(*cells).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*")


def odds_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, spread, minimum, maximum and counts of odds columns; the median comes from exact ranks."""
    medians = {c: exact_quantiles(df, c, [0.5])[0] for c in columns}
    items = [
        F.struct(
            F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("lowest"), F.max(c).alias("highest"),
            F.lit(medians[c]).cast("double").alias("median"), F.count(c).alias("n_valid"), F.count_if(F.col(c).isNull()).alias("n_null"),
        )
        for c in columns
    ]
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*")


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """Equal-width counts of values clipped to the range; the last bin is closed."""
    v = F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi))
    b = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return shares(df.filter(F.col(column).isNotNull()), column).orderBy(F.col("n").desc(), column).limit(limit)


def team_appearances(matches: DataFrame) -> DataFrame:
    return team_game_log(matches).groupBy("team").agg(
        F.count("*").alias("matches"), F.count_if(F.col("is_home") == 1).alias("home"), F.count_if(F.col("is_home") == 0).alias("away")
    )


def home_advantage(matches: DataFrame) -> DataFrame:
    """Home and away win percentages and their gap in points."""
    h, a = F.avg((F.col("result") == "H").cast("double")) * 100, F.avg((F.col("result") == "A").cast("double")) * 100
    return matches.agg(h.alias("home_win_pct"), a.alias("away_win_pct"), (h - a).alias("advantage"))


def outliers(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Values further than `threshold` spreads from their column's mean; columns with five values or more."""
    stats = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))])
    one = {c: stats.select(c).scalar() for c in stats.columns}
    base = df.select(*columns).withColumns({f"_{k}": v for k, v in one.items()})
    items = []
    for i, c in enumerate(columns):
        far = (F.col(f"_n{i}") >= 5) & (F.col(f"_s{i}") > 0) & (F.abs((F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")) > threshold)
        items.append(
            F.struct(
                F.lit(c).alias("column"), F.count_if(far).alias("n_outliers"), F.min(F.when(far, F.col(c))).cast("double").alias("lowest"),
                F.max(F.when(far, F.col(c))).cast("double").alias("highest"),
            )
        )
    return base.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*").filter("n_outliers > 0")


def coverage(df: DataFrame, groups: dict[str, list[str]], by: str) -> DataFrame:
    """Share of rows per key in which any column of a group is filled."""
    cols = []
    for name, columns in groups.items():
        have = [c for c in columns if c in df.columns]
        filled = F.coalesce(*[F.col(c).cast("string") for c in have]).isNotNull() if have else F.lit(False)
        cols.append(F.avg(filled.cast("double")).alias(f"{name}_coverage"))
    return df.groupBy(by).agg(F.count("*").alias("rows"), *cols)


def castable(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Expected columns: present or not, their type, and the share of values that cast to it."""
    types = dict(df.dtypes)
    items = []
    for c, t in expected.items():
        ok = F.avg(F.when(F.col(c).isNotNull(), F.col(c).try_cast(t).isNotNull().cast("double"))) if c in types else F.lit(None).cast("double")
        items.append(F.struct(F.lit(c).alias("column"), F.lit(c in types).alias("present"), F.lit(types.get(c)).alias("actual"), F.lit(t).alias("expected"), ok.alias("castable")))
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*")


def quality_metrics(df: DataFrame) -> DataFrame:
    """Row count, percentage of null cells and of repeated rows."""
    cells = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    out = df.agg(F.count("*").alias("rows"), (total / (F.count("*") * len(df.columns)) * 100).alias("null_pct"))
    return out.withColumn("duplicate_pct", duplicate_summary(df).select("pct").scalar())


# ---------------------------------------------------------------- drift


def _psi(rows: DataFrame, keys: list[str], cur: Column, ref: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum((cur - ref) * F.ln(cur / ref)).alias("psi"))


def psi_equal_width(current: DataFrame, reference: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Stability index per column over equal-width bins of the joint range; 0 with too few rows or no range."""
    both = current.select(*columns).withColumn("_r", F.lit(0)).unionByName(reference.select(*columns).withColumn("_r", F.lit(1)))
    long = both.select("_r", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("_r", columns, "feature", "v").filter("v IS NOT NULL")
    span = long.groupBy("feature").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("_r") == 0).alias("nc"), F.count_if(F.col("_r") == 1).alias("nr")
    )
    b = F.when(F.col("hi") - F.col("lo") < 1e-10, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    counts = long.join(F.broadcast(span), "feature").groupBy("feature", b.alias("bin")).agg(
        F.count_if(F.col("_r") == 0).alias("c"), F.count_if(F.col("_r") == 1).alias("r"), F.first("nc").alias("nc"), F.first("nr").alias("nr"),
        F.first(F.col("hi") - F.col("lo")).alias("range"),
    )
    cur, ref = F.col("c") / F.greatest("nc", F.lit(1)) + EPS, F.col("r") / F.greatest("nr", F.lit(1)) + EPS
    out = counts.groupBy("feature").agg(
        F.sum((cur - ref) * F.ln(cur / ref)).alias("psi"), F.min(F.least("nc", "nr")).alias("_n"), F.min("range").alias("_range")
    )
    return out.select("feature", F.when((F.col("_n") < bins) | (F.col("_range") < 1e-10), 0.0).otherwise(F.col("psi")).alias("psi"))


def psi_quantiles(current: DataFrame, reference: DataFrame, columns: list[str], bins: int = 10, min_samples: int = 30) -> DataFrame:
    """Stability index per column over bins at the reference's exact percentiles, open at both ends."""
    edges = {c: exact_quantiles(reference, c, [i / bins for i in range(bins + 1)]) for c in columns}
    both = current.select(*columns).withColumn("_r", F.lit(0)).unionByName(reference.select(*columns).withColumn("_r", F.lit(1)))
    long = both.select("_r", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("_r", columns, "feature", "v").filter("v IS NOT NULL AND NOT isnan(v)")
    b = F.lit(0)
    for c, e in edges.items():
        place = F.lit(0)
        for x in e[1:-1]:
            place = place + (F.col("v") >= F.lit(x)).cast("int")
        b = F.when(F.col("feature") == c, place).otherwise(b)
    usable = [c for c, e in edges.items() if len(set(e)) > 1]
    counts = long.withColumn("bin", b).groupBy("feature", "bin").agg(F.count_if(F.col("_r") == 0).alias("c"), F.count_if(F.col("_r") == 1).alias("r"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    totals = counts.groupBy("feature").agg(F.sum("c").alias("nc"), F.sum("r").alias("nr"))
    full = totals.select("*", grid.alias("bin")).join(counts, ["feature", "bin"], "left").fillna(0, subset=["c", "r"])
    cur, ref = F.greatest(F.col("c") / F.col("nc"), F.lit(EPS)), F.greatest(F.col("r") / F.col("nr"), F.lit(EPS))
    out = full.groupBy("feature").agg(F.sum((cur - ref) * F.ln(cur / ref)).alias("psi"), F.min(F.least("nc", "nr")).alias("_n"))
    ok = F.col("feature").isin(usable) & (F.col("_n") >= min_samples)
    return out.select("feature", F.when(ok, F.col("psi")).otherwise(0.0).alias("psi"))


def psi_categories(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Stability index of a categorical column with smoothed frequencies."""
    both = current.select(column).withColumn("_r", F.lit(0)).unionByName(reference.select(column).withColumn("_r", F.lit(1)))
    counts = both.groupBy(column).agg(F.count_if(F.col("_r") == 0).alias("c"), F.count_if(F.col("_r") == 1).alias("r"))
    one = counts.agg(F.sum("c").alias("nc"), F.sum("r").alias("nr"), F.count("*").alias("k"))
    k = one.select("k").scalar() * EPS
    counts = counts.withColumns({"_nc": one.select("nc").scalar() + k, "_nr": one.select("nr").scalar() + k})
    cur, ref = (F.col("c") + EPS) / F.col("_nc"), (F.col("r") + EPS) / F.col("_nr")
    return counts.agg(F.lit(column).alias("feature"), F.sum((cur - ref) * F.ln(cur / ref)).alias("psi")).select("feature", "psi")


def drift_report(current: DataFrame, reference: DataFrame, numeric: list[str], categorical: list[str], threshold: float = 0.2) -> DataFrame:
    """Index per feature with a drift flag, and the overall mean in every row."""
    out = psi_quantiles(current, reference, numeric)
    for c in categorical:
        out = out.unionByName(psi_categories(current, reference, c))
    overall = out.agg(F.avg("psi")).scalar()
    return out.withColumn("drifted", F.col("psi") > threshold).withColumn("overall", overall)


def drift_with_moments(current: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """Equal-width index with the shift of mean and spread."""

    def moments(df: DataFrame, tag: str) -> DataFrame:
        items = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias(f"mean_{tag}"), F.stddev_samp(c).alias(f"std_{tag}")) for c in columns]
        return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*")

    out = psi_equal_width(current, reference, columns).join(moments(current, "cur"), "feature").join(moments(reference, "ref"), "feature")
    return out.select("feature", "psi", (F.col("mean_cur") - F.col("mean_ref")).alias("mean_shift"), (F.col("std_cur") - F.col("std_ref")).alias("std_shift"))


def profile_row(df: DataFrame) -> DataFrame:
    """What profile comparisons need, as rows (metric, value): counts, null shares, results, home wins, repeats."""
    results = [F.struct(F.lit(f"result_{r}").alias("metric"), (F.avg((F.col("result") == r).cast("double")) * 100).alias("value")) for r in ("H", "D", "A")]
    nulls = [F.struct(F.lit(f"null_{c}").alias("metric"), (F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100).alias("value")) for c in df.columns]
    base = [
        F.struct(F.lit("rows").alias("metric"), F.count("*").cast("double").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.lit(float(len(df.columns))).alias("value")),
        F.struct(F.lit("home_win").alias("metric"), (F.avg((F.col("result") == "H").cast("double")) * 100).alias("value")),
    ]
    out = df.agg(F.array(*base, *results, *nulls).alias("_s")).select(F.explode("_s").alias("_c")).select("_c.*")
    repeats = duplicate_summary(df).select(F.lit("duplicate_pct").alias("metric"), F.col("pct").alias("value"))
    return out.unionByName(repeats)


def profile_drift(current: DataFrame, previous: DataFrame, row_threshold: float = 0.1, null_threshold: float = 5.0, metric_threshold: float = 0.05) -> DataFrame:
    """Differences between two profiles above their thresholds, with a severity.

    Counts are compared relative to the previous value, percentages in points; a column only one
    side has shows as added or removed.
    """
    c = current.withColumnRenamed("value", "current")
    p = previous.withColumnRenamed("value", "previous")
    both = c.join(p, "metric", "full_outer")
    points = F.abs(F.coalesce("current", F.lit(0.0)) - F.coalesce("previous", F.lit(0.0)))
    relative = F.try_divide(F.col("current") - F.col("previous"), "previous")
    m = F.col("metric")
    is_null, share = m.startswith("null_"), m.startswith("result_") | (m == "home_win")
    severity = (
        F.when(is_null & F.col("previous").isNull(), "warning")
        .when(is_null & F.col("current").isNull(), "critical")
        .when((m == "rows") & (F.abs(relative) >= 1e-9), F.when(F.abs(relative) < row_threshold, "info").when(F.abs(relative) < 3 * row_threshold, "warning").otherwise("critical"))
        .when((m == "columns") & (F.abs(relative) >= 1e-9), F.when(F.abs(relative) < 0.2, "info").when(F.abs(relative) < 0.5, "warning").otherwise("critical"))
        .when(is_null & (points > null_threshold), F.when(points < 2 * null_threshold, "warning").otherwise("critical"))
        .when(share & (points > metric_threshold * 100), F.when(points < 15, "warning").otherwise("critical"))
        .when((m == "duplicate_pct") & (points > 1), F.when(points < 5, "warning").otherwise("critical"))
    )
    delta = F.when(m.isin("rows", "columns"), relative).otherwise(points / 100)
    return both.select("metric", "previous", "current", delta.alias("delta"), severity.alias("severity")).filter("severity IS NOT NULL")


def schema_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Columns added, removed or of another type, from the two schemas alone."""
    new, old = dict(current.dtypes), dict(previous.dtypes)
    rows = [(c, "added", None, t) for c, t in new.items() if c not in old]
    rows += [(c, "removed", t, None) for c, t in old.items() if c not in new]
    rows += [(c, "retyped", old[c], t) for c, t in new.items() if c in old and old[c] != t]
    return current.sparkSession.createDataFrame(rows, "column string, change string, previous string, current string")


# ---------------------------------------------------------------- monitoring


def metric_history(metrics: DataFrame, days: int, metric: str | None = None) -> DataFrame:
    """Rows (metric, ts, value) of the last `days` before the newest one."""
    newest = metrics.agg(F.max("ts")).scalar()
    out = metrics.filter(F.col("ts") >= newest - F.make_interval(days=F.lit(days)))
    return out if metric is None else out.filter(F.col("metric") == metric)


def metric_trend(metrics: DataFrame) -> DataFrame:
    """First against last value per metric; less than 5 % counts as stable."""
    t = metrics.groupBy("metric").agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"), F.count("*").alias("n"))
    pct = F.when((F.col("n") >= 2) & (F.col("first") > 0), (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    t = t.withColumn("change_pct", pct)
    direction = F.when(F.abs("change_pct") < 5, "stable").when(F.col("change_pct") > 0, "up").otherwise("down")
    return t.withColumn("direction", F.when(F.col("n") < 2, "stable").otherwise(direction))


def retain(metrics: DataFrame, days: int) -> DataFrame:
    """Rows to keep when everything older than `days` before the newest is dropped."""
    return metric_history(metrics, days)


def breaches(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows that break a rule (rule, metric, condition, threshold, severity, cooldown)."""
    v, t = F.col("value"), F.col("threshold")
    c = F.col("condition")
    hit = (
        ((c == ">") & (v > t)) | ((c == "<") & (v < t)) | ((c == ">=") & (v >= t)) | ((c == "<=") & (v <= t)) | ((c == "==") & (v == t)) | ((c == "!=") & (v != t))
    )
    return metrics.join(rules, "metric").filter(hit)


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Breaches that fire: after an alert its rule stays silent for the cooldown.

    Whether a breach fires depends on the last one that fired, so a rule is read in time order;
    only that time is kept, and rows arrive sorted in batches.
    """
    hit = breaches(metrics, rules).select("rule", "metric", "ts", "value", "threshold", "severity", "cooldown")
    types = dict(hit.dtypes)
    schema = f"rule string, metric string, ts {types['ts']}, value double, threshold double, severity string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, last = None, None
        for b in batches:
            keep = []
            for i, (r, ts, wait) in enumerate(b[["rule", "ts", "cooldown"]].itertuples(index=False)):
                if r != rule:
                    rule, last = r, None
                if last is None or (ts - last).total_seconds() >= wait:
                    last = ts
                    keep.append(i)
            yield b.iloc[keep][["rule", "metric", "ts", "value", "threshold", "severity"]]

    return hit.repartition("rule").sortWithinPartitions("rule", "ts", "value").mapInPandas(run, schema)


def health_score(reports: DataFrame, system: DataFrame, now: str) -> DataFrame:
    """Score from success rate, recent failures, system load and freshness of the pipeline.

    `reports` is (ts, succeeded, failed); `system` is (ts, cpu, memory, disk) in percent.
    """
    at = F.lit(now).cast("timestamp_ntz")
    r = reports.agg(
        F.sum("succeeded").alias("ok"), F.sum("failed").alias("bad"),
        F.sum(F.when(F.col("ts") >= at - F.make_interval(days=F.lit(7)), F.col("failed"))).alias("recent"), F.max("ts").alias("last"),
    )
    newest = system.agg(F.max_by(F.struct("cpu", "memory", "disk"), "ts").alias("s"))
    r = r.withColumn("s", newest.scalar())

    def load(c: str) -> Column:
        return F.when(F.col(f"s.{c}") > 90, 0.3).when(F.col(f"s.{c}") > 75, 0.1).otherwise(0.0)

    rate = F.coalesce(F.try_divide("ok", F.col("ok") + F.col("bad")), F.lit(1.0))
    penalty = F.least(F.coalesce("recent", F.lit(0)) * 0.05, F.lit(1.0))
    hours = (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 3600
    late = F.when(hours > 48, 0.2).when(hours > 24, 0.1).otherwise(0.0)
    score = (0.4 * rate + 0.6) * (0.2 * (1 - penalty) + 0.8) * (0.2 * (1 - load("cpu") - load("memory") - load("disk")) + 0.8) - late
    return r.select(rate.alias("success_rate"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("health_score"))


def processing_speed(runs: DataFrame) -> DataFrame:
    """Rows per second; 0 without duration."""
    return runs.withColumn("rows_per_second", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")).otherwise(0.0))
