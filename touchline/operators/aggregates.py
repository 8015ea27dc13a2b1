"""Group-by operators: league strength, standings, team strengths, rates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.form import ORDER, team_game_log

LOSS_LIKE = ("loss", "error", "brier", "mse", "mae", "rmse")


def aggregate(df: DataFrame, group_by: list[str], aggregations: dict[str, tuple[str, str]]) -> DataFrame:
    """Generic group-by: `{output: (column, sum|mean|count|min|max)}`; nulls are skipped."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
    return df.groupBy(*group_by).agg(*[fn[how](col).alias(out) for out, (col, how) in aggregations.items()])


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _strength_columns() -> list[Column]:
    hg, ag = F.col("home_goals"), F.col("away_goals")
    scored = (F.avg(hg) + F.avg(ag)) / 2
    return [
        F.count("home_goals").alias("total_matches"),
        F.avg(hg).alias("avg_home_goals"),
        F.avg(ag).alias("avg_away_goals"),
        F.avg(hg + ag).alias("avg_goals"),
        scored.alias("offensive_strength"),
        scored.alias("defensive_strength"),
        F.stddev_samp(hg - ag).alias("std_goal_diff"),
        (F.avg(hg) - F.avg(ag)).alias("home_adv"),
        _share(F.col("result") == "H").alias("home_win_rate"),
        _share(F.col("result") == "D").alias("draw_rate"),
        _share(F.col("result") == "A").alias("away_win_rate"),
        _share((hg > 0) & (ag > 0)).alias("btts_rate"),
        _share(hg + ag > 2.5).alias("over_2_5_rate"),
        F.try_divide(F.sum("home_xg") + F.sum("away_xg"), F.count("home_xg") + F.count("away_xg")).alias("avg_xg"),
    ]


def league_strength(matches: DataFrame, min_matches: int = 20) -> DataFrame:
    """Goals, balance, home advantage and outcome rates per season and league."""
    played = matches.filter("home_goals IS NOT NULL AND away_goals IS NOT NULL")
    return played.groupBy("season", "league").agg(*_strength_columns()).filter(F.col("total_matches") >= min_matches)


def normalise_leagues(strength: DataFrame, reference_league: str, floor: float = 0.01) -> DataFrame:
    """Attack and defence factors relative to the mean of the reference league."""
    ref = strength.filter(F.col("league") == reference_league)
    off = ref.agg(F.greatest(F.avg("offensive_strength"), F.lit(floor)).alias("v")).scalar()
    dfn = ref.agg(F.greatest(F.avg("defensive_strength"), F.lit(floor)).alias("v")).scalar()
    return strength.withColumn("attack_factor", F.col("offensive_strength") / off).withColumn(
        "defence_factor", F.col("defensive_strength") / dfn
    )


def european_adjustment(matches: DataFrame, flagged: DataFrame, min_matches: int = 20) -> DataFrame:
    """League strength with and without the matches of flagged teams (season, league, team).

    Each match is aggregated once under its flag and once in the total, so the table is read once.
    """
    teams = flagged.select("season", "league", F.col("team")).distinct()
    keyed = matches.withColumn("_side", F.explode(F.array("home_team", "away_team")))
    hit = (
        keyed.join(teams, (keyed.season == teams.season) & (keyed.league == teams.league) & (keyed["_side"] == teams.team), "left")
        .groupBy(*[keyed[c] for c in ("match_id", "season", "league", "home_goals", "away_goals", "result", "home_xg", "away_xg")])
        .agg(F.max(teams.team.isNotNull()).alias("_flag"))
    )
    kinds = F.when(F.col("_flag"), F.array(F.lit("with_european"))).otherwise(
        F.array(F.lit("with_european"), F.lit("without_european"))
    )
    return (
        hit.withColumn("type", F.explode(kinds))
        .groupBy("season", "league", "type")
        .agg(*_strength_columns())
        .filter(F.col("total_matches") >= min_matches)
    )


def team_seasons(matches: DataFrame) -> DataFrame:
    return team_game_log(matches).select("team", "season", "league").distinct()


def promotions(team_seasons: DataFrame, tiers: dict[str, list[str]] | None = None) -> DataFrame:
    """Teams that joined or left a league between consecutive seasons of the data.

    With `tiers` ({group: [top league, second, ...]}) a move inside a group is named by its
    direction; otherwise a team is compared with the same league only.
    """
    seasons = team_seasons.select("season").distinct()
    nxt = seasons.withColumn("next_season", F.lead("season").over(Window.partitionBy(F.lit(1)).orderBy("season")))
    ts = team_seasons.select("season", "league", "team").distinct()
    if tiers:
        rows = [(league, group, i) for group, ls in tiers.items() for i, league in enumerate(ls)]
        spark = team_seasons.sparkSession
        ts = ts.join(spark.createDataFrame(rows, "league string, grp string, tier int"), "league")
    else:
        ts = ts.withColumn("grp", F.col("league")).withColumn("tier", F.lit(0))
    prev = ts.join(nxt.filter("next_season IS NOT NULL"), "season").select(
        F.col("next_season").alias("season"), F.col("season").alias("prev_season"), "grp", "team",
        F.col("league").alias("prev_league"), F.col("tier").alias("prev_tier"),
    )
    started = nxt.select(F.col("next_season").alias("season"), F.col("season").alias("_before")).filter("season IS NOT NULL")
    cur = ts.join(started, "season")
    both = cur.join(prev, ["season", "grp", "team"], "full_outer")
    move = (
        F.when(F.col("prev_tier").isNull(), "joined")
        .when(F.col("tier").isNull(), "left")
        .when(F.col("tier") < F.col("prev_tier"), "promoted")
        .when(F.col("tier") > F.col("prev_tier"), "relegated")
    )
    return both.select(
        "season", F.coalesce("prev_season", "_before").alias("prev_season"), "grp", "team", "league", "prev_league", move.alias("move")
    ).filter(F.col("move").isNotNull())


def team_league_mode(matches: DataFrame) -> DataFrame:
    """Most frequent league per team, name as tie-break."""
    counts = team_game_log(matches).groupBy("team", "league").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("league"))).alias("b")
    return counts.groupBy("team").agg(best).select("team", F.col("b.league").alias("league"), (-F.col("b.minus_n")).alias("n"))


def standings(matches: DataFrame) -> DataFrame:
    """Played, wins, draws, losses, goals and points per season, league and team."""
    played = team_game_log(matches.filter("result IS NOT NULL"))
    return played.groupBy("season", "league", "team").agg(*_table_columns())


def standings_rollup(matches: DataFrame) -> DataFrame:
    """Standings with totals over seasons and over leagues."""
    played = team_game_log(matches.filter("result IS NOT NULL"))
    return played.rollup("team", "league", "season").agg(*_table_columns())


def _table_columns() -> list[Column]:
    return [
        F.count("*").alias("played"),
        F.count_if(F.col("points") == 3).alias("wins"),
        F.count_if(F.col("points") == 1).alias("draws"),
        F.count_if(F.col("points") == 0).alias("losses"),
        F.sum("scored").alias("goals_for"),
        F.sum("conceded").alias("goals_against"),
        F.sum("points").alias("points"),
    ]


def model_performance(preds: DataFrame) -> DataFrame:
    """Accuracy, confidence, Brier score and log loss (base 2, floor 0.001) per model."""
    top = F.greatest("p_h", "p_d", "p_a")
    pick = F.when(F.col("p_h") == top, "H").when(F.col("p_d") == top, "D").otherwise("A")
    of_result = F.when(F.col("result") == "H", F.col("p_h")).when(F.col("result") == "D", F.col("p_d")).otherwise(F.col("p_a"))

    def miss(r: str, p: str) -> Column:
        return F.pow((F.col("result") == r).cast("double") - F.col(p), F.lit(2.0))

    return preds.filter("result IS NOT NULL AND p_h IS NOT NULL AND p_d IS NOT NULL AND p_a IS NOT NULL").groupBy("model").agg(
        F.count("*").alias("total_predictions"),
        F.avg((pick == F.col("result")).cast("double")).alias("accuracy"),
        F.avg(top).alias("avg_confidence"),
        F.avg(miss("H", "p_h") + miss("D", "p_d") + miss("A", "p_a")).alias("brier_score"),
        F.avg(-F.log2(F.greatest(of_result, F.lit(0.001)))).alias("log_loss"),
    )


def poisson_strengths(matches: DataFrame, halflife_days: float = 0.0, min_matches: float = 5.0) -> DataFrame:
    """Attack and defence relative to the (recency-weighted) scoring average, per team."""
    ref = matches.agg(F.date_add(F.max("match_date"), 1)).scalar()
    w = F.lit(1.0)
    if halflife_days > 0:
        w = F.pow(F.lit(2.0), -F.greatest(F.datediff(ref, "match_date"), F.lit(0)) / F.lit(halflife_days))
    weighted = matches.withColumn("w", w)
    mu = weighted.agg(
        ((F.sum(F.col("w") * F.col("home_goals")) + F.sum(F.col("w") * F.col("away_goals"))) / F.sum("w") / 2).alias("mu")
    ).scalar()
    sides = weighted.select(
        F.explode(
            F.array(
                F.struct(F.col("home_team").alias("team"), F.col("home_goals").alias("s"), F.col("away_goals").alias("c"), "w"),
                F.struct(F.col("away_team").alias("team"), F.col("away_goals").alias("s"), F.col("home_goals").alias("c"), "w"),
            )
        ).alias("g")
    ).select("g.*")
    per_team = sides.groupBy("team").agg(
        F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("c")).alias("c")
    )
    enough = F.col("weight") >= min_matches
    return per_team.withColumn("_mu", mu).select(
        "team",
        "weight",
        F.when(enough, F.try_divide(F.col("s") / F.col("weight"), "_mu")).otherwise(1.0).alias("attack"),
        F.when(enough, F.try_divide(F.col("c") / F.col("weight"), "_mu")).otherwise(1.0).alias("defence"),
    )


def conditional_rates(matches: DataFrame) -> DataFrame:
    """Both-score rate, over-2.5 rate and mean total, given the result."""
    hg, ag = F.col("home_goals"), F.col("away_goals")
    return matches.groupBy("result").agg(
        _share((hg > 0) & (ag > 0)).alias("btts"), _share(hg + ag > 2.5).alias("over"), F.avg(hg + ag).alias("mean_total")
    )


def rates_row(matches: DataFrame) -> DataFrame:
    """The conditional rates as one row: btts_h, over_h, total_h and so on; 0.5 and 2.5 without data."""
    cols = []
    hg, ag = F.col("home_goals"), F.col("away_goals")
    for r in "HDA":
        here = F.col("result") == r
        k = r.lower()
        cols += [
            F.coalesce(F.avg(F.when(here, ((hg > 0) & (ag > 0)).cast("double"))), F.lit(0.5)).alias(f"btts_{k}"),
            F.coalesce(F.avg(F.when(here, (hg + ag > 2.5).cast("double"))), F.lit(0.5)).alias(f"over_{k}"),
            F.coalesce(F.avg(F.when(here, hg + ag)), F.lit(2.5)).alias(f"total_{k}"),
        ]
    return matches.agg(*cols)


def goals_markets_from_1x2(preds: DataFrame, rates: DataFrame, threshold: float = 2.5, cap: float = 0.95) -> DataFrame:
    """Both-score and over probabilities as outcome probabilities times conditional rates."""
    scale = threshold / 2.5
    one = {c: rates.select(c).scalar() for c in rates.columns if not c.startswith("total")}
    btts = sum((F.col(f"p_{k}") * one[f"btts_{k}"] for k in "hda"), F.lit(0.0))
    over = sum((F.col(f"p_{k}") * F.least(one[f"over_{k}"] * scale, F.lit(cap)) for k in "hda"), F.lit(0.0))
    return preds.withColumn("p_btts", btts).withColumn("p_over", over)


def shot_conversion(matches: DataFrame, cap: float = 0.5, fallback: float = 0.25) -> DataFrame:
    """Goals per shot on target and league, capped."""
    sot = F.sum("home_sot") + F.sum("away_sot")
    goals = F.sum("home_goals") + F.sum("away_goals")
    return matches.groupBy("league").agg(
        F.when(sot > 0, F.least(goals / sot, F.lit(cap))).otherwise(fallback).alias("conversion")
    )


def xg_from_shots(matches: DataFrame) -> DataFrame:
    """Expected goals as shots on target times the league's conversion, clipped to 0..8."""
    joined = matches.join(shot_conversion(matches), "league")

    def xg(side: str) -> Column:
        raw = F.coalesce(F.col(f"{side}_sot"), F.lit(0)) * F.col("conversion")
        return F.least(F.greatest(raw, F.lit(0.0)), F.lit(8.0)).alias(f"{side}_xg_est")

    return joined.select(*matches.columns, xg("home"), xg("away"))


def overdispersion(matches: DataFrame, floor: float = 0.8, default: float = 1.2, min_rows: int = 5) -> DataFrame:
    """Per league: median over shot counts of variance / mean of goals."""
    pairs = matches.select(
        "league",
        F.explode(
            F.array(
                F.struct(F.col("home_sot").alias("sot"), F.col("home_goals").alias("goals")),
                F.struct(F.col("away_sot").alias("sot"), F.col("away_goals").alias("goals")),
            )
        ).alias("p"),
    ).select("league", "p.*").filter("sot IS NOT NULL AND goals IS NOT NULL")
    per_sot = pairs.groupBy("league", "sot").agg(
        F.count("*").alias("n"), F.avg("goals").alias("mean"), F.var_samp("goals").alias("var")
    )
    usable = F.col("var").isNotNull()
    grouped = per_sot.groupBy("league").agg(
        F.sum("n").alias("n"),
        F.count("sot").alias("levels"),
        F.count_if(usable).alias("groups"),
        F.sum(F.when(usable, F.col("mean"))).alias("means"),
        F.median(F.when(usable, F.try_divide("var", "mean"))).alias("ratio"),
    )
    few = (F.col("n") < min_rows) | (F.col("levels") < 2) | (F.col("groups") < 3) | (F.col("means") == 0)
    return grouped.select("league", F.when(few, default).otherwise(F.greatest("ratio", F.lit(floor))).alias("overdispersion"))


def form_scores(matches: DataFrame, n_matches: int = 5, min_matches: int = 3) -> DataFrame:
    """2 * points / (3n) - 1 over each team's last `n` games; 0 with too few games."""
    log = team_game_log(matches.filter("result IS NOT NULL"))
    newest = Window.partitionBy("team").orderBy(*[F.col(c).desc() for c in ORDER])
    last = log.select("team", *ORDER, "points").withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n_matches)
    n = F.count("*")
    return last.groupBy("team").agg(
        F.when(n >= min_matches, F.sum("points") / (n * 3) * 2 - 1).otherwise(0.0).alias("form_score"), n.alias("games")
    )


def fit_target_encoding(df: DataFrame, column: str, target: Column) -> DataFrame:
    return df.groupBy(column).agg(F.avg(target).alias(f"{column}_te"))


def apply_target_encoding(df: DataFrame, encoding: DataFrame, column: str, prior: float) -> DataFrame:
    """Join the learned means; categories not seen in training get the prior."""
    return df.join(encoding, column, "left").withColumn(f"{column}_te", F.coalesce(f"{column}_te", F.lit(prior)))


def strength_bins(matches: DataFrame, edges: list[float]) -> DataFrame:
    """Mean totals per bin of the two teams' average expected goals."""
    level = (F.col("home_xg") + F.col("away_xg")) / 2
    b = F.lit(0)
    for i, e in enumerate(edges, 1):
        b = F.when(level >= e, i).otherwise(b)
    total = F.col("home_goals") + F.col("away_goals")
    return matches.withColumn("bin", b).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(total).alias("avg_total"), _share(total > 2.5).alias("over_rate")
    )


def team_totals(matches: DataFrame, top: int = 10) -> DataFrame:
    """Teams with the most goals scored; goals conceded beside them."""
    return (
        team_game_log(matches)
        .groupBy("team")
        .agg(F.sum("scored").alias("scored"), F.sum("conceded").alias("conceded"), F.count("*").alias("games"))
        .orderBy(F.col("scored").desc(), "team")
        .limit(top)
    )


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def goal_histogram(matches: DataFrame) -> DataFrame:
    """How often each number of goals was scored at home and away."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_goals").alias("goals")),
            F.struct(F.lit("away").alias("side"), F.col("away_goals").alias("goals")),
        )
    )
    counts = matches.select(sides.alias("s")).select("s.*").groupBy("goals", "side").agg(F.count("*").alias("n"))
    return counts.groupBy("goals").agg(
        F.coalesce(F.max(F.when(F.col("side") == "home", F.col("n"))), F.lit(0)).alias("home_n"),
        F.coalesce(F.max(F.when(F.col("side") == "away", F.col("n"))), F.lit(0)).alias("away_n"),
    )


def side_record(matches: DataFrame) -> DataFrame:
    """Win, draw and loss rates and goals by side."""
    return team_game_log(matches).groupBy("is_home").agg(
        _share(F.col("points") == 3).alias("win_rate"),
        _share(F.col("points") == 1).alias("draw_rate"),
        _share(F.col("points") == 0).alias("loss_rate"),
        F.avg("scored").alias("avg_scored"),
    )


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregation; long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return row.select(F.explode(entries).alias("p")).select("p.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Null count and share per column, in one pass; long form."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"c{i}")).alias("nulls")) for i, c in enumerate(df.columns)]
    )
    return row.select("_n", F.explode(entries).alias("e")).select(
        "e.*", (F.col("e.nulls") / F.greatest(F.col("_n"), F.lit(1))).alias("share")
    )


def database_statistics(matches: DataFrame) -> DataFrame:
    """Row, league, season and team counts with the date range, overall and per league."""
    sides = team_game_log(matches)
    return sides.groupBy("league").agg(
        F.countDistinct("match_id").alias("matches"),
        F.countDistinct("team").alias("teams"),
        F.countDistinct("season").alias("seasons"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
    )


def is_loss_like(metric: Column) -> Column:
    hit = F.lit(False)
    for word in LOSS_LIKE:
        hit = hit | F.lower(metric).contains(word)
    return hit


def rank_runs(metrics: DataFrame, metric: str, limit: int = 20) -> DataFrame:
    """Runs (run_id, metric, value) ranked by one metric; losses ascending, scores descending."""
    ascending = any(w in metric.lower() for w in LOSS_LIKE)
    key = F.col("value") if ascending else -F.col("value")
    top = metrics.filter(F.col("metric") == metric).withColumn("_k", key).orderBy("_k", "run_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy("metric").orderBy("_k", "run_id"))
    return top.select("run_id", "value", rank.alias("rank"))


def best_runs(metrics: DataFrame) -> DataFrame:
    """Best run per metric (lowest loss, highest score); the smaller run id wins ties."""
    key = F.when(is_loss_like(F.col("metric")), F.col("value")).otherwise(-F.col("value"))
    best = metrics.groupBy("metric").agg(F.min(F.struct(key.alias("k"), "run_id", "value")).alias("b"))
    return best.select("metric", F.col("b.run_id").alias("run_id"), F.col("b.value").alias("value"))


def runs_wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Runs by metrics table."""
    return metrics.groupBy("run_id").pivot("metric", names).agg(F.max("value"))


def success_rate(tasks: DataFrame, days: int) -> DataFrame:
    """Share of successful tasks (ok, ts) in the `days` before the newest one."""
    newest = tasks.agg(F.max("ts")).scalar()
    recent = tasks.filter(F.col("ts") >= newest - F.make_interval(days=F.lit(days)))
    return recent.agg(F.count("*").alias("total"), _share(F.col("ok")).alias("success_rate"))


def xg_per_match(matches: DataFrame) -> DataFrame:
    """Season sums of expected goals for and against, divided by games."""
    return team_game_log(matches).groupBy("season", "team").agg(
        F.count("*").alias("games"), F.avg("xg").alias("xg_per_match"), F.avg("xga").alias("xga_per_match")
    )


def scale_xg_by_team_rate(matches: DataFrame, rates: DataFrame) -> DataFrame:
    """Multiply each side's expected goals by the ratio of the team's known rate to its observed one."""
    log = team_game_log(matches)
    observed = log.groupBy("team").agg(F.avg("xg").alias("observed"))
    factor = observed.join(rates, "team").select("team", F.try_divide("xg_rate", "observed").alias("factor"))
    return log.join(factor, "team", "left").select(
        "match_id", "team", "is_home", (F.col("xg") * F.coalesce("factor", F.lit(1.0))).alias("xg_scaled")
    )
