"""Goal models fitted as sums by team, against the likelihood itself."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import goal_models as gm

SCHEMA = "league string, match_date date, match_id long, home_team string, away_team string, home_goals int, away_goals int"


@pytest.fixture(scope="module")
def matches(spark):
    import datetime

    rnd = random.Random(5)
    power = {f"t{i:02d}": rnd.uniform(-0.4, 0.4) for i in range(12)}
    rows = []
    for i in range(900):
        h, a = rnd.sample(sorted(power), 2)
        rows.append(("x" if i % 3 else "y", datetime.date(2020, 1, 1) + datetime.timedelta(days=i // 4), i, h, a, int(np.random.default_rng(i).poisson(np.exp(0.3 + power[h]))), int(np.random.default_rng(10_000 + i).poisson(np.exp(power[a])))))
    rows += [("x", rows[0][1], 9000, "t00", "t01", None, 1), ("x", rows[0][1], 9001, None, "t01", 1, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def likelihood(rows, of, gamma, rho, ridge):
    """Log likelihood of one model; `of` has (alpha, beta) by team."""
    out = 0.0
    for _, _, _, h, a, g, c in rows:
        if h is None or g is None:
            continue
        lam, mu = np.exp(of[h][0] + of[a][1] + gamma), np.exp(of[a][0] + of[h][1])
        low = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.get((g, c), 1.0)
        out += g * np.log(lam) - lam + c * np.log(mu) - mu + np.log(low)
    return out - ridge * sum(x * x for p in of.values() for x in p)


def test_no_parameter_can_be_improved(matches, ridge=0.5):
    rows, df = matches
    pairs = gm.pair_sums(df, keys=("league",))
    fit = gm.fit_goal_models(pairs, ["league"], ridge).collect()
    for league in ("x", "y"):
        mine = [r for r in rows if r[0] == league]
        of = {r.team: (r.alpha, r.beta) for r in fit if r.league == league}
        gamma, rho = next((r.gamma, r.rho) for r in fit if r.league == league)
        best = likelihood(mine, of, gamma, rho, ridge)
        assert of["t00"] == (0.0, 0.0)
        for step in (0.01, -0.01):
            assert likelihood(mine, of, gamma + step, rho, ridge) < best
            assert likelihood(mine, of, gamma, rho + step, ridge) < best
            for t in sorted(of)[1:]:
                for moved in ((of[t][0] + step, of[t][1]), (of[t][0], of[t][1] + step)):
                    assert likelihood(mine, of | {t: moved}, gamma, rho, ridge) < best


def test_balances_and_warm_start(matches):
    _, df = matches
    pairs = gm.pair_sums(df.withColumn("model", F.lit(1)), keys=("model",))
    fit = gm.fit_goal_models(pairs, ["model"])
    left = [(r.scored_left, r.conceded_left) for r in gm.balances(pairs, fit, ["model"]).orderBy("team").collect()]
    assert left[0] == (None, None) and max(abs(x) for p in left[1:] for x in p) < 1e-3
    again = gm.fit_goal_models(pairs, ["model"], start=fit, rounds=1)
    assert {r.team: r.alpha for r in again.collect()} == pytest.approx({r.team: r.alpha for r in fit.collect()}, abs=1e-6)


def test_team_without_goals_and_empty_table(spark, matches):
    _, df = matches
    silent = df.withColumn("home_goals", F.when(F.col("home_team") == "t05", 0).otherwise(F.col("home_goals"))).withColumn("away_goals", F.when(F.col("away_team") == "t05", 0).otherwise(F.col("away_goals")))
    pairs = gm.pair_sums(silent.withColumn("model", F.lit("m")), keys=("model",))
    fit = {r.team: r.alpha for r in gm.fit_goal_models(pairs, ["model"], rounds=5).collect()}
    assert fit["t05"] == -gm.BOUND and all(abs(v) < gm.BOUND for t, v in fit.items() if t != "t05")
    assert gm.fit_goal_models(pairs.where("w < 0"), ["model"], rounds=1).count() == 0


def test_sums_handed_on_to_later_blocks(matches):
    rows, df = matches
    blocks = gm.refit_blocks(df.where("home_team IS NOT NULL AND home_goals IS NOT NULL"), 100, 300)
    block_of = {r.match_id: r.block for r in blocks.collect()}
    by_day = {}
    for r in sorted((r for r in rows if r[2] in block_of), key=lambda r: (r[1], r[2])):
        by_day.setdefault(r[1], []).append(r[2])
    assert all(len({block_of[i] for i in ids}) == 1 for ids in by_day.values())
    counts = [sum(b == k for b in block_of.values()) for k in sorted(set(block_of.values()))]
    assert counts == [100, 200, 300, 300]
    starts = {b: min(r[1] for r in rows if block_of.get(r[2]) == b) for b in set(block_of.values())}
    want = {}
    for _, day, i, h, a, g, c in rows:
        for b, start in starts.items():
            if i in block_of and block_of[i] < b:
                w = 2 ** (-(start - day).days / 50)
                at = want.setdefault((b, h, a), [0.0, 0.0])
                at[0] += w
                at[1] += w * g
    got = {(r.block, r.home_team, r.away_team): [r.w, r.hg] for r in gm.sums_before_blocks(blocks, 50.0).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    rated = gm.as_of_rates(blocks, F.col("block"), 50.0).collect()
    assert len(rated) == 900 and all((r.lam is None) == (r.block == 0) for r in rated)
