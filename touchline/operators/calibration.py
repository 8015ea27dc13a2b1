"""Calibration curves of many keys at once: monotone curves by pooling, logistic curves by Newton steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.shared import written

_FOLD = 8  # neighbouring ranges that one task of the next round pools


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(c / (1 - c))


def with_suffix(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """The table with its keys renamed, and the null-safe condition that joins it on them."""
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    return df.withColumnsRenamed({k: f"_k_{k}" for k in keys}), on


def _pool(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Merge neighbouring blocks of a key, which come in order, until their means rise."""
    columns = [*keys, "lo", "hi", "total", "weight"]
    owner, stack = None, []

    def flush() -> pd.DataFrame:
        return pd.DataFrame([(*owner, *b) for b in stack], columns=columns)

    for batch in batches:
        for row in batch[columns].astype({k: object for k in keys}).itertuples(index=False, name=None):
            key, block = tuple(None if pd.isna(k) else k for k in row[: len(keys)]), row[len(keys) :]
            if key != owner:
                if stack:
                    yield flush()
                owner, stack = key, []
            lo, hi, total, weight = block
            while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                lo, _, t, w = stack.pop()
                total, weight = total + t, weight + w
            stack.append((lo, hi, total, weight))
    if stack:
        yield flush()


def monotone_curve(df: DataFrame, keys: list[str], prob: str, label: str) -> DataFrame:
    """Blocks (keys, lo, hi, total, weight, value) of the non-decreasing curve of least squares per key.

    Rows are summed per exact probability, dealt by ranges of it and pooled in each range; ranges are then joined eight at a time, where
    only the blocks that are left are read. Pooling in parts gives the blocks of one pass over all, since a merge that is due stays due.
    With labels 0 and 1 a curve over N rows has at most about N^(2/3) blocks (corners of a convex lattice path), which bounds the last
    round. Rows with a null or NaN probability or a null label are left out; an empty table gives no blocks.
    """
    p, y = F.col(prob).cast("double"), F.col(label).cast("double")
    points = df.where(p.isNotNull() & ~F.isnan(p) & y.isNotNull()).groupBy(*keys, p.alias("lo")).agg(F.sum(y).alias("total"), F.count("*").cast("double").alias("weight"))
    blocks = points.select(*keys, "lo", F.col("lo").alias("hi"), "total", "weight")
    schema = blocks.schema
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(n, *keys, "lo") if n > 1 else blocks.repartition(*keys) if keys else blocks.coalesce(1)
        blocks = written(dealt.sortWithinPartitions(*keys, "lo").mapInPandas(lambda batches: _pool(batches, keys), schema), "blocks")
        if n <= 1:
            return blocks.withColumn("value", F.col("total") / F.col("weight"))
        n //= _FOLD


def on_curve(df: DataFrame, curve: DataFrame, keys: list[str], prob: str, out: str, cells: int = 1024) -> DataFrame:
    """Column `out`: the curve of the row's key at its probability, straight between blocks and constant beyond the ends.

    Blocks and rows meet on key and cell of the value, so no task sees a whole key of rows. Null and NaN probabilities and keys without
    a curve get null.
    """

    def cell(c: Column) -> Column:
        return F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int")

    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("lo")
    parts = curve.select(*keys, "lo", "hi", "value", F.lead("lo").over(order).alias("to"), F.lead("value").over(order).alias("then"), F.lag("lo").over(order).alias("_before"))
    start = F.when(F.col("_before").isNull(), F.lit(float("-inf"))).otherwise(F.col("lo"))
    spans = F.sequence(F.when(F.col("_before").isNull(), 0).otherwise(cell(F.col("lo"))), F.when(F.col("to").isNull(), cells - 1).otherwise(cell(F.col("to"))))
    parts = parts.select(*keys, F.struct(start.alias("start"), "hi", "value", "to", "then").alias("_part"), F.explode(spans).alias("_kcell"))
    parts, on = with_suffix(parts.groupBy(*keys, "_kcell").agg(F.sort_array(F.collect_list("_part")).alias("_parts")), keys)
    p = F.col(prob).cast("double")
    part = F.try_element_at(F.filter("_parts", lambda s: s["start"] <= p), F.lit(-1))
    rows = df.withColumn("_cell", F.when(p.isNotNull() & ~F.isnan(p), cell(p))).join(parts, on & (F.col("_cell") == F.col("_kcell")), "left").withColumn("_part", part)
    low, hi = F.col("_part.value"), F.col("_part.hi")
    between = low + (F.col("_part.then") - low) * (p - hi) / (F.col("_part.to") - hi)
    return rows.withColumn(out, F.when((p <= hi) | F.col("_part.to").isNull(), low).otherwise(between)).select(*df.columns, out)


def sigmoid_curve(df: DataFrame, keys: list[str], prob: str, label: str, rounds: int = 30, settled: float = 1e-9) -> DataFrame:
    """Slope and shift per key of the logistic curve on the logit of a probability, of highest likelihood.

    Each Newton step of all keys is one aggregation over counts per probability; the parameters are written each round and only the
    largest move reaches the driver. Keys whose labels are all alike or separable stop at the last round with a steep curve.
    """
    p, y = F.col(prob).cast("double"), F.col(label).cast("double")
    known = df.where(p.isNotNull() & ~F.isnan(p) & y.isNotNull()).groupBy(*keys, logit(p).alias("_x")).agg(F.sum(y).alias("_s"), F.count("*").cast("double").alias("_n"))
    points = written(known, "logits")
    fit = written(points.groupBy(*keys).agg(F.lit(1.0).alias("slope"), F.lit(0.0).alias("shift")), "sigmoids")
    for _ in range(rounds):
        x, n = F.col("_x"), F.col("_n")
        q = 1 / (1 + F.exp(-(F.col("slope") * x + F.col("shift"))))
        w, miss = n * q * (1 - q), F.col("_s") - n * q
        sums = {"_ga": miss * x, "_gb": miss, "_aa": w * x * x, "_ab": w * x, "_bb": w}
        side, on = with_suffix(fit, keys)
        moved = points.join(side, on).groupBy(*keys, "slope", "shift").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
        da = F.coalesce(F.try_divide(F.col("_bb") * F.col("_ga") - F.col("_ab") * F.col("_gb"), det), F.lit(0.0))
        db = F.coalesce(F.try_divide(F.col("_aa") * F.col("_gb") - F.col("_ab") * F.col("_ga"), det), F.lit(0.0))
        da, db = (F.least(F.greatest(d, F.lit(-2.0)), F.lit(2.0)) for d in (da, db))  # no leaps beyond what the curvature can tell
        moved = written(moved.select(*keys, (F.col("slope") + da).alias("slope"), (F.col("shift") + db).alias("shift"), F.greatest(F.abs(da), F.abs(db)).alias("_move")), "sigmoids")
        fit, move = moved.drop("_move"), moved.agg(F.max("_move")).first()[0]
        if move is None or move < settled:
            break
    return fit


def on_sigmoid(df: DataFrame, fit: DataFrame, keys: list[str], prob: str, out: str) -> DataFrame:
    """Column `out`: the logistic curve of the row's key at its probability; null where the key has none."""
    side, on = with_suffix(fit.select(*keys, F.col("slope").alias("_slope"), F.col("shift").alias("_shift")), keys)
    value = 1 / (1 + F.exp(-(F.col("_slope") * logit(F.col(prob)) + F.col("_shift"))))
    return df.join(side, on, "left").withColumn(out, value).select(*df.columns, out)
