"""Fuzzy names: nearest spellings against all pairs, and no broadcast of the shortened spellings."""

from __future__ import annotations

import duckdb

from touchline.operators import joins


def test_nearest_names_are_those_of_all_pairs_without_broadcast(spark):
    keys = [f"club {i:03d}"[: 8 - i % 2] for i in range(40)] + ["far away from all", "abc"]
    known = [(f"club {i:03d}", f"C{i % 7}") for i in range(0, 60, 3)] + [("club 000", "A0")]
    got = joins.nearest_names(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(known, "spelling string, canonical string"))
    rows = sorted(tuple(r) for r in got.collect())
    values = ", ".join(f"('{s}', '{c}')" for s, c in known)
    names = ", ".join(f"('{k}')" for k in dict.fromkeys(keys))
    want = duckdb.sql(f"""SELECT key, min((d, canonical))[2], min((d, canonical))[1] FROM (SELECT key, canonical, levenshtein(key, spelling) AS d
        FROM (VALUES {names}) n(key), (VALUES {values}) k(spelling, canonical)) z WHERE d <= 2 AND length(key) >= 4 GROUP BY key ORDER BY key""").fetchall()
    assert rows == want and len(rows) > 20
    # A name stands for hundreds of shortened spellings, so a side that looks small must not go to the driver.
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
