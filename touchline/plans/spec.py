"""Named feature operators, declarative feature lists and SQL functions.

An operator is a DataFrame -> DataFrame function with the columns it needs and adds. A feature list
names operators with parameters in the order they apply; the result is one lazy plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import clean, form, goal_models, history, market


@dataclass(frozen=True)
class Operator:
    """A feature step: checks its input, transforms, checks its output."""

    name: str
    apply: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, **params: object) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} needs columns {missing}")
        out = self.apply(df, **params)
        absent = [c for c in self.adds if c not in out.columns]
        if absent:
            raise ValueError(f"{self.name} did not add {absent}")
        return out


OPERATORS: dict[str, Operator] = {}


def register(op: Operator) -> Operator:
    if op.name in OPERATORS:
        raise ValueError(f"operator {op.name!r} is already registered")
    OPERATORS[op.name] = op
    return op


def operator(name: str, needs: tuple[str, ...] = (), adds: tuple[str, ...] = ()) -> Callable:
    """Decorator that registers a function as an operator."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        register(Operator(name, fn, needs, adds))
        return fn

    return wrap


_MATCH = ("match_id", "match_date", "home_team", "away_team", "home_goals", "away_goals", "result")


@operator("form", _MATCH)
def _form(df: DataFrame, windows: tuple[int, ...] = (5,), metrics: tuple[str, ...] = ("points", "goals_scored")) -> DataFrame:
    chosen = {m: form.FORM_METRICS[m] for m in metrics}
    rolled = form.rolling(form.team_game_log(df), chosen, tuple(windows), ["team"])
    sides = form.to_match_rows(rolled, [f"{m}_avg{w}" for m in metrics for w in windows])
    return df.join(sides, "match_id")


@operator("head_to_head", _MATCH, ("home_win_rate",))
def _h2h(df: DataFrame, window: int = 6) -> DataFrame:
    return history.ordered_pair_h2h(df, window)


@operator("rest_days", _MATCH, ("h_rest_days", "a_rest_days"))
def _rest(df: DataFrame, per_league: bool = False) -> DataFrame:
    return df.join(form.to_match_rows(history.schedule(df, per_league), ["rest_days"]), "match_id")


@operator("goal_rates", _MATCH, ("expected_home_goals",))
def _rates(df: DataFrame, halflife_days: float = 180.0) -> DataFrame:
    return df.join(goal_models.poisson_as_of(df, halflife_days), "match_id")


@operator("market", ("odds_h", "odds_d", "odds_a", "close_h", "close_d", "close_a"), ("market_favorite",))
def _market(df: DataFrame) -> DataFrame:
    return market.odds_features(df)


@operator("calendar", ("match_date",), ("day_of_week",))
def _calendar(df: DataFrame) -> DataFrame:
    return clean.calendar_features(df)


@dataclass(frozen=True)
class FeatureList:
    """Steps read from JSON or given as dictionaries: {"type": operator, "params": {...}}."""

    steps: tuple[dict, ...] = field(default_factory=tuple)

    @classmethod
    def from_json(cls, text: str) -> FeatureList:
        return cls(tuple(json.loads(text)["features"]))

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            if s.get("enabled", True):
                df = OPERATORS[s["type"]](df, **s.get("params", {}))
        return df


# ---------------------------------------------------------------- SQL functions

# Scalar formulas as SQL functions; Spark inlines them, so they stay in the generated code.
SQL_FUNCTIONS = {
    "expected_value": ("p DOUBLE, o DOUBLE", "DOUBLE", "CASE WHEN o > 1 THEN least(greatest(p, 0D), 1D) * o - 1 ELSE 0D END"),
    "kelly_fraction": ("p DOUBLE, o DOUBLE", "DOUBLE", "CASE WHEN o > 1 AND p * o > 1 THEN least((p * o - 1) / (o - 1), 1D) ELSE 0D END"),
    "closing_line_value": ("taken DOUBLE, closing DOUBLE", "DOUBLE", "CASE WHEN taken > 1 AND closing > 1 THEN (taken - closing) / closing ELSE 0D END"),
    "elo_expected": ("home DOUBLE, away DOUBLE", "DOUBLE", "1 / (1 + pow(10D, (away - home - 100) / 400))"),
}


def register_functions(spark: SparkSession) -> None:
    """Make the formulas available to SQL text, with a table function for the score grid."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION score_grid(lam DOUBLE, mu DOUBLE) RETURNS TABLE (home_score INT, away_score INT, probability DOUBLE) RETURN
        SELECT i, j, exp(-lam) * pow(lam, i) / factorial(i) * exp(-mu) * pow(mu, j) / factorial(j)
        FROM (SELECT explode(sequence(0, 5)) AS i) a LATERAL VIEW explode(sequence(0, 5)) b AS j"""
    )


def compute_per_entity(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """Custom computer: `fn` maps the rows of one entity, given as an iterator of pandas frames, to rows."""
    return df.groupBy(key).applyInPandas(fn, schema)


def compute_column(df: DataFrame, name: str, fn: Callable) -> DataFrame:
    """Custom computer as a Column expression over the frame's columns."""
    return df.withColumn(name, fn({c: F.col(c) for c in df.columns}))
