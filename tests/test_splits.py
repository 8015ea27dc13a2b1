"""Walk-forward folds: rows of every fold by loops, and fold sizes without forming these rows."""

from __future__ import annotations

import datetime as dt

from touchline.operators import splits


def _rows(spark, n: int):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(day + dt.timedelta(days=i // 3), i) for i in range(n)], "match_date date, match_id long")


def test_rows_of_walk_forward_folds(spark):
    for n in (0, 9, 10, 14, 23):
        got = splits.walk_forward_folds(_rows(spark, n), ["match_date", "match_id"], 10, 4)
        want = sorted((i, k + 1, "train" if i < 10 + 4 * k else "val") for k in range(max((n - 10) // 4, 0)) for i in range(14 + 4 * k))
        assert got.columns == ["match_date", "match_id", "fold", "role"]
        assert sorted((r.match_id, r.fold, r.role) for r in got.collect()) == want


def test_fold_sizes_without_the_rows_of_all_folds(spark):
    n = 30_000  # 14 500 folds of single-digit size; their rows would be 219 million
    spans = splits.walk_forward_folds(_rows(spark, n), ["match_date", "match_id"], 1000, 2, spans=True)
    assert spans.count() <= 2 * n
    got = sorted(tuple(r) for r in splits.fold_sizes(spans).collect())
    assert got == [(k + 1, 1000 + 2 * k, 2) for k in range(14_500)]


def test_fold_sizes_fill_folds_without_a_change(spark):
    spans = spark.createDataFrame([("train", 2, 5), ("train", 4, 5000), ("val", 4, 4), ("train", 9000, 9001)], "role string, first_fold long, last_fold long")
    sizes = {r.fold: (r.train_size, r.val_size) for r in splits.fold_sizes(spans).collect()}
    assert sorted(sizes) == [*range(2, 5001), 9000, 9001]
    assert [sizes[k] for k in (2, 3, 4, 5, 6, 4500, 5000, 9001)] == [(1, 0), (1, 0), (2, 1), (2, 0), (1, 0), (1, 0), (1, 0), (1, 0)]
