"""Time-ordered train, validation and test splits and rolling folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.windows import with_row_index
from touchline.sources.shared import written


def chronological_split(
    df: DataFrame, order: list[str], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), unit: str = "month"
) -> DataFrame:
    """Tag rows train, val or test by their place in time; the test part is the newest."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    indexed = with_row_index(df, [], order, "_row", unit)
    n = df.agg(F.count("*")).scalar()
    test = F.ceil(n * F.lit(ratios[2]))
    val = F.ceil((n - test) * F.lit(ratios[1] / (ratios[0] + ratios[1])))
    part = F.when(F.col("_row") < n - test - val, "train").when(F.col("_row") < n - test, "val").otherwise("test")
    return indexed.withColumn("split", part).drop("_row")


def date_split(df: DataFrame, date: str, train: tuple[str, str], val: tuple[str, str], test: tuple[str, str]) -> DataFrame:
    """Tag rows by half-open date ranges; rows in none of them are dropped."""

    def inside(r: tuple[str, str]) -> Column:
        return (F.col(date) >= F.to_date(F.lit(r[0]))) & (F.col(date) < F.to_date(F.lit(r[1])))

    part = F.when(inside(train), "train").when(inside(val), "val").when(inside(test), "test")
    return df.withColumn("split", part).filter(F.col("split").isNotNull())


def _with_folds(indexed: DataFrame, folds: Column, role: Column) -> DataFrame:
    return (
        indexed.withColumn("fold", F.explode(folds))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .drop("_row")
    )


def expanding_folds(df: DataFrame, order: list[str], n_splits: int = 5, gap: int = 0, unit: str = "month") -> DataFrame:
    """`n_splits` folds; each trains on everything (less a gap) before its validation part."""
    n = df.agg(F.count("*")).scalar()
    size = F.floor(n / F.lit(n_splits + 1))
    start = n - (F.lit(n_splits) - F.col("fold") + 1) * size
    row = F.col("_row")
    role = F.when(row < start - gap, "train").when((row >= start) & (row < start + size), "val")
    return _with_folds(with_row_index(df, [], order, "_row", unit), F.sequence(F.lit(1), F.lit(n_splits)), role)


def sliding_folds(
    df: DataFrame, order: list[str], window_size: int, horizon: int, step: int = 1, unit: str = "month"
) -> DataFrame:
    """Folds with a training window of fixed size; a row appears in the folds that contain it."""
    n = df.agg(F.count("*")).scalar()
    span = window_size + horizon
    row = F.col("_row")
    last = F.least(F.floor(row / step), F.floor((n - span) / step))
    first = F.greatest(F.floor((row - span) / step) + 1, F.lit(0))
    folds = F.when((n >= span) & (first <= last), F.sequence(first + 1, last + 1))
    within = row - (F.col("fold") - 1) * step
    role = F.when(within < window_size, "train").otherwise("val")
    return _with_folds(with_row_index(df, [], order, "_row", unit), folds, role)


def walk_forward_folds(
    df: DataFrame, order: list[str], initial_train_size: int, val_size: int, unit: str = "month", spans: bool = False
) -> DataFrame:
    """Train on all rows up to a point, validate on the next `val_size`, move forward.

    A row trains in every fold after its own, so the rows of all folds grow with the square of the input. With `spans` there is
    instead one row per row and role, with the `first_fold` and `last_fold` of an unbroken run of folds: at most two per input row.
    """
    base = written(df, "folds")  # counted and numbered
    n_folds = F.lit((base.count() - initial_train_size) // val_size).cast("long")
    row = F.col("_row")
    own = F.floor((row - initial_train_size) / val_size) + 1  # fold that validates on the row, if it is none of the first rows
    start = F.when(row < initial_train_size, F.lit(1).cast("long")).otherwise(own + 1)
    runs = F.array(
        F.struct(F.lit("val").alias("role"), F.when(row >= initial_train_size, own).alias("first_fold"), own.alias("last_fold")),
        F.struct(F.lit("train").alias("role"), start.alias("first_fold"), n_folds.alias("last_fold")),
    )
    kept = F.filter(runs, lambda r: (r["first_fold"] <= r["last_fold"]) & (r["last_fold"] <= n_folds))
    out = with_row_index(base, [], order, "_row", unit).select(*df.columns, F.explode(kept).alias("_run"))
    if spans:
        return out.select(*df.columns, "_run.*")
    return out.select(*df.columns, F.explode(F.sequence("_run.first_fold", "_run.last_fold")).alias("fold"), F.col("_run.role").alias("role"))


_FOLDS = 4096  # folds of one stretch of running sums


def fold_sizes(spans: DataFrame) -> DataFrame:
    """Rows that train and validate in each fold, from runs of folds (`role`, `first_fold`, `last_fold`); empty folds have no row.

    A run counts up at its first fold and down behind its last one; sizes are running sums of these, in stretches of folds that
    take over the sums of earlier stretches.
    """
    runs = spans.groupBy("role", "first_fold", "last_fold").agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col("first_fold").alias("fold"), F.col("n").alias("step")), F.struct((F.col("last_fold") + 1).alias("fold"), (-F.col("n")).alias("step")))
    steps = runs.select("role", F.explode(ends).alias("e")).groupBy("e.fold").agg(
        *[F.sum(F.when(F.col("role") == r, F.col("e.step")).otherwise(0)).alias(r) for r in ("train", "val")]
    )
    steps = steps.withColumn("part", F.floor(F.col("fold") / _FOLDS))
    parts = steps.groupBy("part").agg(F.sum("train").alias("_t"), F.sum("val").alias("_v"), F.min("fold").alias("_first"))
    every = Window.orderBy("part")  # one row per stretch
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.sum("_t").over(before).alias("_t"), F.sum("_v").over(before).alias("_v"), F.lead("_first").over(every).alias("_after"))
    inside = Window.partitionBy("part").orderBy("fold")
    to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("part", "fold", F.sum("train").over(to_here).alias("t"), F.sum("val").over(to_here).alias("v"), F.lead("fold").over(inside).alias("_next"))
    sums = sums.join(parts, "part").select(
        "fold", F.coalesce("_next", "_after").alias("_next"), (F.col("t") + F.coalesce("_t", F.lit(0))).alias("train_size"), (F.col("v") + F.coalesce("_v", F.lit(0))).alias("val_size")
    )
    held = sums.filter("train_size + val_size > 0")
    return held.select(F.explode(F.sequence("fold", F.col("_next") - 1)).alias("fold"), "train_size", "val_size")
