"""Odds, expected value, stake fractions and the closing-line measures, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def implied(odds: Column) -> Column:
    return F.lit(1.0) / odds


def margin(odds: list[Column]) -> Column:
    """Sum of implied probabilities minus one."""
    return total([implied(o) for o in odds]) - 1


def fair_probs(odds: list[Column]) -> list[Column]:
    """Implied probabilities without the margin."""
    book = total([implied(o) for o in odds])
    return [implied(o) / book for o in odds]


def complement_odds(odds: Column) -> Column:
    """Odds of the opposite outcome in a two-way market without margin."""
    return F.lit(1.0) / (1 - implied(odds))


def clip01(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def expected_value(prob: Column, odds: Column, digits: int | None = None) -> Column:
    """p * o - 1 with p clipped to 0..1; 0 when the odds are not above 1."""
    ev = F.when(odds > 1, clip01(prob) * odds - 1).otherwise(0.0)
    return ev if digits is None else F.round(ev, digits)


def edge(prob: Column, odds: Column) -> Column:
    """Probability minus implied probability."""
    return F.when(odds > 1, clip01(prob) - implied(odds)).otherwise(0.0)


def fair_odds(prob: Column) -> Column:
    return F.when(prob > 0, F.lit(1.0) / clip01(prob))


def kelly(prob: Column, odds: Column, digits: int | None = None) -> Column:
    """(p * o - 1) / (o - 1) within 0..1; 0 without positive expected value."""
    p = clip01(prob)
    k = F.when((odds > 1) & (p * odds > 1), F.least((p * odds - 1) / (odds - 1), F.lit(1.0))).otherwise(0.0)
    return k if digits is None else F.round(k, digits)


# Share of the full Kelly fraction per risk profile.
RISK_PROFILES = {"conservative": 0.10, "moderate": 0.25, "balanced": 0.50, "aggressive": 0.75, "max": 1.0}


def clv_price(taken: Column, closing: Column, digits: int = 6) -> Column:
    """(taken - closing) / closing; 0 when a price is not above 1."""
    return F.round(F.when((taken > 1) & (closing > 1), (taken - closing) / closing).otherwise(0.0), digits)


def clv_fair_shift(open_odds: list[Column], close_odds: list[Column]) -> list[Column]:
    """Fair closing probability minus fair opening probability."""
    return [c - o for c, o in zip(fair_probs(close_odds), fair_probs(open_odds), strict=True)]


def clv_implied_shift(taken: Column, closing: Column) -> Column:
    """1 / closing - 1 / taken."""
    return implied(closing) - implied(taken)


def clv_model(prob: Column, fair_close: Column) -> Column:
    """(fair closing probability - model probability) / model probability; 0 if either is not positive."""
    return F.when((prob > 0) & (fair_close > 0), (fair_close - prob) / prob).otherwise(0.0)


def clv_live(current: Column, previous: Column) -> Column:
    """(current - previous) / previous odds; 0 on first sight."""
    return F.when(previous > 0, (current - previous) / previous).otherwise(0.0)


def clv_mean_edge(prob: Column, odds: Column) -> Column:
    """Model probability minus implied probability; its mean is the last of the six measures."""
    return prob - implied(odds)
