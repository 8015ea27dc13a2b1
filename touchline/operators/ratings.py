"""Order-dependent ratings: Elo and the four-rating statistic model.

Every update needs the ratings the update before it left, so one rating pool (a league, a country)
is read in order by one task. The JVM sorts the pool (spilling if needed), Python sees it in Arrow
batches and keeps one number per team, and only the narrow columns of the update pass through.
Pools run side by side; `start` continues from stored ratings, so a long history can be run season
by season with each season's ratings written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import goals as G
from touchline.operators.form import ORDER
from touchline.sources.shared import written


@dataclass(frozen=True)
class EloRules:
    home_advantage: float = 100.0
    initial: float = 1500.0
    regress: float = 1 / 3
    host_bonus: float = 50.0


_ELO_OUT = "home_elo double, away_elo double, expected_home double, home_elo_after double, away_elo_after double"


def elo_history(
    matches: DataFrame, k: Column, pool: str | None = None, rules: EloRules = EloRules(), host: Column | None = None,
    season: str | None = "season", start: DataFrame | None = None, final: bool = False,
) -> DataFrame:
    """Ratings of both teams before and after each match, or with `final` each team's last rating.

    `k` is the K factor per match. When the season changes, all ratings of the pool move a share
    of the way to their mean. `start` holds (pool, team, rating) to continue from.
    """
    keyed = matches.select(
        (F.col(pool).cast("string") if pool else F.lit("all")).alias("pool"),
        "match_date", "match_id", "home_team", "away_team",
        F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).when(F.col("result") == "A", 0.0).alias("score"),
        k.cast("double").alias("k"),
        (host if host is not None else F.lit(False)).alias("host"),
        (F.col(season).cast("string") if season else F.lit("")).alias("season"),
        F.lit(None).cast("double").alias("rating"),
    )
    if start is not None:
        seed = start.select("pool", F.col("team").alias("home_team"), "rating", F.lit(None).cast("date").alias("match_date"))
        keyed = keyed.unionByName(seed, allowMissingColumns=True)
    ordered = keyed.repartition("pool").sortWithinPartitions("pool", F.col("match_date").asc_nulls_first(), F.col("match_id").asc_nulls_first())
    schema = "pool string, team string, rating double" if final else f"pool string, match_id bigint, home_team string, away_team string, match_date date, {_ELO_OUT}"
    return ordered.mapInPandas(lambda batches: _fold_elo(batches, rules, final), schema)


def _fold_elo(batches: Iterator[pd.DataFrame], rules: EloRules, final: bool) -> Iterator[pd.DataFrame]:
    pool: str | None = None
    rating: dict[str, float] = {}
    season: str | None = None

    def table() -> pd.DataFrame:
        return pd.DataFrame([(pool, t, v) for t, v in rating.items()], columns=["pool", "team", "rating"])

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.pool != pool:
                if final and rating:
                    yield table()
                pool, rating, season = r.pool, {}, None
            if r.rating is not None and r.rating == r.rating:
                rating[r.home_team] = r.rating
                continue
            if season is not None and r.season != season and rating:
                mean = sum(rating.values()) / len(rating)
                rating = {t: mean + (v - mean) * (1 - rules.regress) for t, v in rating.items()}
            season = r.season
            h = rating.setdefault(r.home_team, rules.initial)
            a = rating.setdefault(r.away_team, rules.initial)
            boosted = h + (rules.host_bonus if r.host else 0.0)
            expected = 1 / (1 + 10 ** ((a - boosted - rules.home_advantage) / 400))
            move = r.k * (r.score - expected) if r.score == r.score else 0.0
            rating[r.home_team], rating[r.away_team] = h + move, a - move
            out.append((pool, r.match_id, r.home_team, r.away_team, r.match_date, h, a, expected, h + move, a - move))
        if final:
            continue
        yield pd.DataFrame(
            out,
            columns=["pool", "match_id", "home_team", "away_team", "match_date", "home_elo", "away_elo", "expected_home", "home_elo_after", "away_elo_after"],
        ).astype({"match_id": "int64"})
    if final and rating:
        yield table()


def elo(matches: DataFrame, pool: str | None = None, k: float = 32.0, use_xg: bool = True, **kwargs) -> DataFrame:  # noqa: ANN003
    """Elo with a margin-dependent K factor."""
    margin = F.abs(F.coalesce(F.col("home_goals"), F.lit(0)) - F.coalesce(F.col("away_goals"), F.lit(0)))
    xg = F.abs(F.col("home_xg") - F.col("away_xg")) if use_xg else None
    return elo_history(matches, G.elo_k(k, margin, xg), pool, **kwargs)


def elo_framework(matches: DataFrame, pool: str | None = None, k: float = 20.0, tier: Column | None = None, **kwargs) -> DataFrame:  # noqa: ANN003
    """Elo with importance and tier factors on K; new teams start at 1300."""
    goals = F.abs(F.coalesce(F.col("home_goals"), F.lit(0)) - F.coalesce(F.col("away_goals"), F.lit(0)))
    name = F.col("league")
    factor = G.elo_framework_k(k, goals, G.match_importance(name), G.tier_factor(name, tier))
    return elo_history(matches, factor, pool, EloRules(initial=1300.0), **kwargs)


def team_ratings(history: DataFrame) -> DataFrame:
    """Every team's rating after each match, in long form."""
    sides = F.explode(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.col("home_elo").alias("before"), F.col("home_elo_after").alias("after")),
            F.struct(F.col("away_team").alias("team"), F.col("away_elo").alias("before"), F.col("away_elo_after").alias("after")),
        )
    )
    return history.select("pool", "match_date", "match_id", sides.alias("s")).select(
        "pool", "match_date", "match_id", "s.*", (F.col("s.after") - F.col("s.before")).alias("change")
    )


def trajectory(history: DataFrame, team: str) -> DataFrame:
    return team_ratings(history).filter(F.col("team") == team).orderBy(*ORDER)


def top_rated(final: DataFrame, limit: int = 10) -> DataFrame:
    return final.orderBy(F.col("rating").desc(), "team").limit(limit)


def predict_from_ratings(fixtures: DataFrame, ratings: DataFrame, initial: float = 1500.0, advantage: float = 100.0, draw_share: float = 0.25) -> DataFrame:
    """Outcome and both-score probabilities of fixtures from current ratings."""
    out = fixtures
    for side in ("home", "away"):
        named = ratings.select(F.col("team").alias(f"{side}_team"), F.col("rating").alias(f"{side}_rating"))
        out = out.join(named, f"{side}_team", "left").fillna(initial, subset=[f"{side}_rating"])
    out = out.withColumn("expected", G.elo_expected(F.col("home_rating"), F.col("away_rating"), advantage))
    probs = G.elo_outcome_probs(F.col("expected"), draw_share)
    return out.withColumns({f"p_{n}": c for n, c in probs.items()} | {"p_btts": G.elo_btts(F.col("home_rating"), F.col("away_rating"))})


# ---------------------------------------------------------------- statistic ratings


@dataclass(frozen=True)
class StatRules:
    k: float = 8.0
    initial: float = 5.0
    home_bonus: float = 0.5
    halflife_days: float = 365.0


def stat_rating_history(matches: DataFrame, stat: str = "sot", pool: str | None = None, rules: StatRules = StatRules()) -> DataFrame:
    """Expected statistic of both sides before each match, from four ratings per team.

    The statistic is standardised over the whole frame (population spread), clipped to five
    spreads; a rating moves by k * recency weight * (observed - expected).
    """
    v = [F.col(f"home_{stat}"), F.col(f"away_{stat}")]
    values = matches.select("match_date", F.explode(F.array(*v)).alias("v"))
    wide = F.stddev_pop("v")
    # The three numbers are read here, so that neither the update nor what follows evaluates the matches again for them.
    mean, spread, last = values.agg(F.coalesce(F.avg("v"), F.lit(5.0)), F.when(wide >= 0.1, wide).otherwise(1.0), F.date_add(F.max("match_date"), 1)).first()

    def standard(c: str) -> Column:
        return F.least(F.greatest((F.col(c) - F.lit(mean)) / F.lit(spread), F.lit(-5.0)), F.lit(5.0))

    weight = F.lit(1.0)
    if rules.halflife_days > 0:
        age = F.greatest(F.datediff(F.lit(last).cast("date"), F.col("match_date")), F.lit(0))
        weight = F.greatest(F.pow(F.lit(2.0), -age / rules.halflife_days), F.lit(0.01))
    keyed = matches.filter(F.col(f"home_{stat}").isNotNull() & F.col(f"away_{stat}").isNotNull()).select(
        (F.col(pool).cast("string") if pool else F.lit("all")).alias("pool"), "match_date", "match_id", "home_team", "away_team",
        standard(f"home_{stat}").alias("obs_home"), standard(f"away_{stat}").alias("obs_away"), weight.alias("w"),
    )
    schema = "pool string, match_id bigint, exp_home double, exp_away double"
    ordered = keyed.repartition("pool").sortWithinPartitions("pool", "match_date", "match_id")
    return ordered.mapInPandas(lambda batches: _fold_stat(batches, rules, mean, spread), schema)


def _fold_stat(batches: Iterator[pd.DataFrame], rules: StatRules, mean: float, spread: float) -> Iterator[pd.DataFrame]:
    pool, r = None, {}
    at_home, away = rules.initial + rules.home_bonus, rules.initial
    for batch in batches:
        out = []
        for m in batch.itertuples(index=False):
            if m.pool != pool:
                pool, r = m.pool, {}
            # [home attack, home defence, away attack, away defence]
            h = r.setdefault(m.home_team, [at_home, at_home, away, away])
            a = r.setdefault(m.away_team, [at_home, at_home, away, away])
            exp_h, exp_a = (h[0] + a[3]) / 2, (a[2] + h[1]) / 2
            gap_h, gap_a = rules.k * m.w * (m.obs_home - exp_h), rules.k * m.w * (m.obs_away - exp_a)
            h[0] += gap_h
            a[3] += gap_h
            h[1] += gap_a
            a[2] += gap_a
            out.append((pool, m.match_id, max(exp_h * spread + mean, 0.01), max(exp_a * spread + mean, 0.01)))
        yield pd.DataFrame(out, columns=["pool", "match_id", "exp_home", "exp_away"]).astype({"match_id": "int64"})


def stat_rating_over_model(matches: DataFrame, expected: DataFrame):  # noqa: ANN201
    """Logistic regression of over 2.5 goals on the expected statistics, classes weighted evenly; its rows are written once."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = expected.join(matches.select("match_id", (F.col("home_goals") + F.col("away_goals") > 2.5).cast("double").alias("label")), "match_id")
    data = written(data, "rated")
    data = data.withColumns({"exp_total": F.col("exp_home") + F.col("exp_away"), "exp_diff": F.col("exp_home") - F.col("exp_away")})
    share = data.agg(F.avg("label")).first()[0]
    data = data.withColumn("_share", F.lit(share).cast("double")).withColumn(
        "weight", F.when(F.col("label") == 1, 0.5 / F.greatest("_share", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("_share"), F.lit(1e-9)))
    )
    frame = VectorAssembler(inputCols=["exp_home", "exp_away", "exp_total", "exp_diff"], outputCol="features").transform(data)
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100).fit(frame)
    return model, frame
