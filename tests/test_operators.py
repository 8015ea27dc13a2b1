"""Operators against brute force and hand-made cases."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from touchline.functions import goals as G
from touchline.functions import text
from touchline.operators import bets, joins, quantiles, ratings
from touchline.operators.form import with_expected_goals
from touchline.operators.windows import Expanding, Previous, Trailing, pick_unit, with_asof, with_decayed_means, with_ewm
from touchline.plans import inputs
from touchline.streaming import live

DAY = dt.date(2020, 1, 1)


def _series(spark, n=60):
    rows = [("a" if i % 3 else "b", DAY + dt.timedelta(days=i * 9), i, float((i * 7) % 11)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, d date, i int, v double")


def test_blocks_change_nothing(spark):
    """Every calendar unit gives what one window over the whole key gives."""
    rows, df = _series(spark)
    feats = {"t": Trailing(F.col("v"), 4), "e": Expanding(F.col("v")), "p": Previous(F.col("v"), 2), "m": Expanding(F.col("v"), "max")}
    for unit in ("year", "month", "day"):
        got = {r["i"]: r for r in with_asof(df, ["k"], ["d", "i"], feats, unit).collect()}
        for k, _, i, _v in rows:
            past = [v for kk, _, j, v in rows if kk == k and j < i]
            want = sum(past[-4:]) / len(past[-4:]) if past else None
            assert got[i]["t"] == want or math.isclose(got[i]["t"], want)
            assert (got[i]["e"] is None) == (not past) and (not past or math.isclose(got[i]["e"], sum(past) / len(past)))
            assert got[i]["p"] == (past[-2] if len(past) > 1 else None)
            assert got[i]["m"] == (max(past) if past else None)


def test_later_rows_never_change_earlier_features(spark):
    rows, df = _series(spark)
    changed = df.withColumn("v", F.when(F.col("i") >= 40, F.lit(99.0)).otherwise(F.col("v")))
    feats = {"t": Trailing(F.col("v"), 5), "e": Expanding(F.col("v"))}

    def early(frame):
        return {(r["i"], r["t"], r["e"]) for r in with_asof(frame, ["k"], ["d", "i"], feats, "month").filter("i <= 40").collect()}

    assert early(df) == early(changed)


def test_ewm_with_nulls(spark):
    rows, df = _series(spark, 40)
    df = df.withColumn("v", F.when(F.col("i") % 5 != 0, F.col("v")))
    got = {r["i"]: r["x"] for r in with_ewm(df, ["k"], ["d", "i"], {"x": (F.col("v"), 3.0)}, "month").collect()}
    for k, _, i, _v in rows:
        past = [(v if j % 5 else None) for kk, _, j, v in rows if kk == k and j < i]
        w = [(0.5 ** (age / 3.0), v) for age, v in enumerate(reversed(past))]
        den = sum(a for a, v in w if v is not None)
        if den:
            assert math.isclose(got[i], sum(a * v for a, v in w if v is not None) / den, rel_tol=1e-9)
        else:
            assert got[i] is None


def test_exact_quantiles(spark):
    df = spark.range(1, 1002).select((F.col("id") * 2.0).alias("v"))
    assert quantiles.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]) == [2.0, 502.0, 1002.0, 2002.0]


def test_elo_zero_sum_and_seed(spark):
    m = inputs.matches(spark, "/root/testdata/sf0.001")
    h = ratings.elo(m, "league", season=None).selectExpr("home_elo + away_elo - home_elo_after - away_elo_after AS d").agg(F.max(F.abs("d"))).first()[0]
    assert h < 1e-9
    early, late = m.filter("season < 1998"), m.filter("season >= 1998")
    whole = {(r["pool"], r["team"]): r["rating"] for r in ratings.elo(m, season=None, final=True).collect()}
    first = ratings.elo(early, season=None, final=True)
    second = {(r["pool"], r["team"]): r["rating"] for r in ratings.elo(late, season=None, start=first, final=True).collect()}
    assert all(math.isclose(whole[k], v, abs_tol=1e-6) for k, v in second.items())


def test_ruin_and_push(spark):
    rows = [(DAY, 1, 1.0, "lost"), (DAY, 2, 2.0, "won"), (DAY, 3, 0.0, "push")]
    b = spark.createDataFrame([("s", d, i, (r if s == "won" else -1.0 if s == "lost" else 0.0), s) for d, i, r, s in rows], "k string, match_date date, match_id int, unit_return double, status string")
    out = {r["match_id"]: r for r in bets.compound(b, ["k"], F.lit(1.0), 100.0).collect()}
    assert out[1]["bankroll_after"] == 0.0 and out[2]["stake"] == 0.0 and out[3]["profit"] == 0.0


def test_settle_push_on_whole_line(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0), (1, 1, 2.5)], "h int, a int, line double")
    s = bets.settle(F.lit("OU"), F.lit("over"), F.col("h"), F.col("a"), F.col("line"))
    assert [r[0] for r in df.select(s).collect()] == ["push", "won", "lost"]


def test_money_and_names(spark):
    df = spark.createDataFrame([("€75.00m",), ("€1.2bn",), ("€500k",), ("-",)], "t string")
    assert [r[0] for r in df.select(text.parse_market_value(F.col("t"))).collect()] == [75.0, 1200.0, 0.5, 0.0]
    names = spark.createDataFrame([("Arsnal",), ("Chelsea FC",), ("Nobody",)], "name string")
    alias = spark.createDataFrame([("arsenal", "Arsenal"), ("chelsea", "Chelsea")], "alias string, canonical string")
    got = {r["name"]: (r["canonical"], r["method"]) for r in joins.resolve_names(names, alias).collect()}
    assert got == {"Arsnal": ("Arsenal", "fuzzy"), "Chelsea FC": ("Chelsea", "suffix"), "Nobody": ("Nobody", "fallback")}


def test_score_markets_sum_to_one(spark):
    df = spark.createDataFrame([(1.4, 1.1), (0.3, 2.2)], "lam double, mu double")
    for r in G.with_score_markets(df, "lam", "mu", 0.1).collect():
        assert math.isclose(r["home_win"] + r["draw"] + r["away_win"], 1.0) and 0 < r["over_2_5"] < 1


def test_reachable_goes_all_the_way(spark):
    from touchline.operators.versions import reachable

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(15)], "parent string, child string")
    rows = reachable(edges, spark.createDataFrame([("n0",)], "node string")).collect()
    assert sorted((r.depth, r.node) for r in rows) == [(i, f"n{i}") for i in range(1, 16)]


def test_time_folds_never_train_on_later_rows(spark):
    from touchline.operators.learning import time_folds

    data = spark.createDataFrame([(i, i // 4) for i in range(16)], "day int, fold int")
    folds = time_folds(data, "fold")
    assert len(folds) == 3
    for past, now in folds:
        assert max(r.day for r in past.collect()) < min(r.day for r in now.collect())


def test_quantiles_equal_sorted_values(spark):
    import random

    from touchline.operators.quantiles import exact_quantiles

    rnd = random.Random(1)
    values = [rnd.gauss(0, 1) for _ in range(4000)] + [5.0] * 300 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = sorted(values)
    for p, got in zip((0.0, 0.1, 0.5, 0.99, 1.0), exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.99, 1.0]), strict=True):
        at = p * (len(s) - 1)
        lo = int(at)
        assert abs(got - (s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (at - lo))) < 1e-9


def test_closing_odds_keeps_rows_without_prices(spark):
    from touchline.sources.tabular import closing_odds, closing_pair

    df = spark.createDataFrame([(1, "2.0"), (2, None)], "match_id int, over string")
    out = closing_odds(df)
    assert out.count() == 2 and "closing_source" in out.columns
    paired = closing_pair(df.withColumn("under", F.lit("1.8")), "over", [("over", "under")])
    assert {r.match_id: r.closing_over_yes for r in paired.collect()} == {1: 2.0, 2: None}


def test_decayed_means_do_not_overflow_or_depend_on_gaps(spark):
    """Short half-lives over long series, segments of any length, and a key that rests for decades."""
    rows = [("a" if i % 3 else "b", DAY + dt.timedelta(days=i * 37 + (9000 if i > 50 else 0)), i, float((i * 7) % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, d date, i int, v double")
    for halflife, span in ((1.0, 366), (7.0, 5), (180.0, 31), (0.0, 31)):
        got = {r["i"]: r["x"] for r in with_decayed_means(df, ["k"], ["d", "i"], {"x": F.col("v")}, halflife, span).collect()}
        for k, d, i, _v in rows:
            past = [(dd, v) for kk, dd, j, v in rows if kk == k and j < i]
            if not past:
                assert got[i] is None
                continue
            last = max(dd for dd, _ in past)
            w = [(2.0 ** ((dd - last).days / halflife) if halflife else 1.0, v) for dd, v in past]
            assert math.isclose(got[i], sum(a * v for a, v in w) / sum(a for a, _ in w), rel_tol=1e-9, abs_tol=1e-9)


def test_blocks_follow_the_counts(spark):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i // 4)) for i in range(400)], "k string, d date")
    assert [pick_unit(df, ["k"], "d", "year", n) for n in (400, 399, 200, 30, 4, 1)] == ["year", "quarter", "month", "week", "day", "day"]


def test_expected_goal_columns(spark):
    df = spark.createDataFrame([(1, 0.5, 1.5)], "i int, H_xG double, XGAWAY double")
    named, known = with_expected_goals(df)
    assert known and named.columns == ["i", "home_xg", "away_xg"]
    empty, known = with_expected_goals(df.drop("XGAWAY"))
    assert not known and empty.select("home_xg", "away_xg").first() == (0.0, 0.0)


def test_late_and_repeated_snapshots(spark, tmp_path):
    """The log keeps everything, the cycle drops repeats, and a late snapshot is flagged without changing the state."""
    at = dt.datetime(2020, 1, 1, 12)
    schema = "match_key long, outcome string, snapshot_id long, ts timestamp, odds double"
    waves = [[(1, "H", 1, 10, 2.0), (1, "H", 3, 30, 2.2)], [(1, "H", 2, 20, 9.0), (1, "H", 3, 30, 2.2)], [(1, "H", 4, 40, 3.3)]]
    for n, wave in enumerate(waves):
        rows = [(m, o, s, at + dt.timedelta(seconds=t), odds) for m, o, s, t, odds in wave]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    stream = live.read_stream(spark, f"{tmp_path}/in*", schema, files_per_batch=1)
    moves = {(r.snapshot_id, r.batch): r for r in live.run_to_table(live.movement(live.deduplicated(stream, ["snapshot_id"])), "moves").collect()}
    by_id = {s: r for (s, _), r in moves.items()}
    assert len(moves) == 4 and [s for s, r in by_id.items() if r.late] == [2] and by_id[2].live_clv is None
    assert math.isclose(by_id[3].live_clv, 0.1) and math.isclose(by_id[4].live_clv, 0.5) and by_id[1].live_clv == 0
    predictions = spark.createDataFrame([(1, "H", 0.6, 0.1)], "match_key long, outcome string, prob double, spread double")
    live.run_cycle(stream, predictions, f"{tmp_path}/out", ["snapshot_id"])
    assert spark.read.parquet(f"{tmp_path}/out/log").count() == 5
    assert spark.read.parquet(f"{tmp_path}/out/predictions").count() == 4
