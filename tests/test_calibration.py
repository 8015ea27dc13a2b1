"""Calibration curves against plain ones."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import calibration as cal

SCHEMA = "m string, p double, y int"


def plain_curve(points: list[tuple[float, int]]) -> dict[float, float]:
    """Value at each point: the largest, over starts, of the smallest mean from there on that reaches the point."""
    xs = sorted({p for p, _ in points})
    s = [sum(y for p, y in points if p == x) for x in xs]
    w = [sum(p == x for p, _ in points) for x in xs]
    return {
        x: max(min(sum(s[a : b + 1]) / sum(w[a : b + 1]) for b in range(i, len(xs))) for a in range(i + 1))
        for i, x in enumerate(xs)
    }


def rows(n: int, seed: int, m: str | None) -> list[tuple]:
    rng = random.Random(seed)
    ps = [round(rng.random(), 2) for _ in range(n)]
    return [(m, p, int(rng.random() < 0.2 + 0.5 * p)) for p in ps]


def test_monotone_curve_is_the_best_one(spark):
    data = rows(200, 1, "a") + rows(60, 2, "b") + rows(30, 3, None) + [("a", 0.5, 1)] * 150  # a third of the rows at one value
    df = spark.createDataFrame([*data, ("a", None, 1), ("a", math.nan, 0), ("b", 0.3, None)], SCHEMA)
    curve = cal.monotone_curve(df, ["m"], "p", "y")
    for m in ("a", "b", None):
        want = plain_curve([(p, y) for k, p, y in data if k == m])
        blocks = curve.where(F.col("m").eqNullSafe(F.lit(m))).orderBy("lo").collect()
        got = {x: next(b.value for b in blocks if b.lo <= x <= b.hi) for x in want}
        assert got == pytest.approx(want)
        assert all(a.value < b.value for a, b in zip(blocks, blocks[1:]))
        assert sum(b.weight for b in blocks) == sum(k == m for k, _, _ in data)


def test_rows_lie_on_their_curve(spark):
    curve = spark.createDataFrame([("a", 0.2, 0.3, 0.1), ("a", 0.5, 0.5, 0.4), ("a", 0.7, 0.9, 0.8), (None, 0.1, 0.1, 0.6)], "m string, lo double, hi double, value double")
    asked = [("a", 0.0), ("a", 0.25), ("a", 0.4), ("a", 0.5), ("a", 0.6), ("a", 0.95), ("a", 7.0), ("a", None), (None, 0.9), ("c", 0.5)]
    got = cal.on_curve(spark.createDataFrame(asked, "m string, p double"), curve, ["m"], "p", "q").collect()
    want = {("a", 0.0): 0.1, ("a", 0.25): 0.1, ("a", 0.4): 0.25, ("a", 0.5): 0.4, ("a", 0.6): 0.6, ("a", 0.95): 0.8, ("a", 7.0): 0.8, (None, 0.9): 0.6}
    assert len(got) == len(asked)
    for r in got:
        assert r.q == (pytest.approx(want[r.m, r.p]) if (r.m, r.p) in want else None)


def test_logistic_curve_settles_where_its_slopes_vanish(spark):
    data = rows(400, 4, "a") + rows(300, 5, "b")
    fit = {r.m: r for r in cal.sigmoid_curve(spark.createDataFrame(data, SCHEMA), ["m"], "p", "y").collect()}
    for m in "ab":
        x = [(math.log(max(p, 1e-6) / max(1 - p, 1e-6)) if 1e-6 < p < 1 - 1e-6 else math.copysign(math.log((1 - 1e-6) / 1e-6), p - 0.5), y) for k, p, y in data if k == m]
        miss = [(y - 1 / (1 + math.exp(-(fit[m].slope * v + fit[m].shift))), v) for v, y in x]
        assert sum(d for d, _ in miss) == pytest.approx(0, abs=1e-6)
        assert sum(d * v for d, v in miss) == pytest.approx(0, abs=1e-6)


def test_empty_tables_and_no_keys(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cal.monotone_curve(none, ["m"], "p", "y").count() == 0
    assert cal.sigmoid_curve(none, ["m"], "p", "y").count() == 0
    data = rows(50, 6, "a")
    df = spark.createDataFrame(data, SCHEMA)
    want = plain_curve([(p, y) for _, p, y in data])
    got = cal.on_curve(df, cal.monotone_curve(df, [], "p", "y"), [], "p", "q").collect()
    assert all(r.q == pytest.approx(want[r.p]) for r in got) and len(got) == 50
