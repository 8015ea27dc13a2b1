"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
NAMES = ["form_rolling", "league_positions", "standings", "odds_features", "resolve_names", "risk_frequency", "drift_quantiles", "version_delta", "score_markets", "elo_by_league", "elo_history"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_stream_equals_batch(spark):
    q = entry.queries()
    rows = [sorted(map(tuple, q[n](spark, SF).select("user_id", "window_start", "n").collect())) for n in ("stream_sliding_counts", "batch_sliding_counts")]
    assert rows[0] == rows[1]
