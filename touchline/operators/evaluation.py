"""Probability metrics, calibration, blending and confidence."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.calibration import monotone_curve, on_curve, on_sigmoid, sigmoid_curve, with_suffix
from touchline.sources.shared import written

CLASSES = ("h", "d", "a")


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def renormalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Divide by the row sum; rows that sum to 0 get equal shares."""
    total = _sum([F.col(c) for c in columns])
    return df.withColumns({c: F.when(total > 0, F.col(c) / total).otherwise(1.0 / len(columns)) for c in columns})


def softmax(columns: list[Column]) -> list[Column]:
    top = F.greatest(*columns)
    grown = [F.exp(c - top) for c in columns]
    return [g / _sum(grown) for g in grown]


def entropy(columns: list[Column]) -> Column:
    """- sum p ln p, with 0 ln 0 = 0."""
    return -_sum([F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in columns])


def is_class(k: str) -> Column:
    return (F.col("result") == k.upper()).cast("double")


def brier_multi() -> Column:
    return _sum([F.pow(is_class(k) - F.col(f"p_{k}"), F.lit(2.0)) for k in CLASSES])


def log_loss_multi(floor: float = 1e-15) -> Column:
    of_result = F.when(F.col("result") == "H", F.col("p_h")).when(F.col("result") == "D", F.col("p_d")).otherwise(F.col("p_a"))
    return -F.ln(F.greatest(of_result, F.lit(floor)))


def pick() -> Column:
    top = F.greatest("p_h", "p_d", "p_a")
    return F.when(F.col("p_h") == top, "H").when(F.col("p_d") == top, "D").otherwise("A")


def outcome_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, Brier score and log loss of 1X2 probabilities per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((pick() == F.col("result")).cast("double")).alias("accuracy"),
        F.avg(brier_multi()).alias("brier"), F.avg(log_loss_multi()).alias("log_loss"),
    )


def binary_metrics(df: DataFrame, prob: str, label: str, keys: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score and log loss of a probability per key."""
    p, y = F.col(prob), F.col(label).cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = (p >= 0.5).cast("double")
    tp, fp, fn = F.sum(hit * y), F.sum(hit * (1 - y)), F.sum((1 - hit) * y)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((hit == y).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"), F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_loss"),
    )


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by actual and predicted result."""
    return df.groupBy(*keys, "result", pick().alias("predicted")).agg(F.count("*").alias("n"))


def roc_auc(df: DataFrame, prob: str, label: str, keys: list[str], blocks: int = 4096) -> DataFrame:
    """Area under the ROC curve from counts per exact probability value, ties counted half.

    Running sums go over blocks of values first and then within each block, so no task sorts all values of a key.
    """
    from pyspark.sql import Window

    per = df.groupBy(*keys, F.col(prob).alias("_p")).agg(F.sum(F.col(label).cast("long")).alias("_pos"), F.sum(1 - F.col(label).cast("long")).alias("_neg"))
    per = per.withColumn("_b", F.floor(F.col("_p") * blocks))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.groupBy(*keys, "_b").agg(F.sum("_neg").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(base.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_b": "_kb"}), reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.col("_b").eqNullSafe(F.col("_kb"))))
    out = out.withColumn("_below", F.col("_base") + F.coalesce(F.sum("_neg").over(w), F.lit(0)))
    pairs = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return out.groupBy(*keys).agg(F.try_divide(pairs, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))


# ---------------------------------------------------------------- calibration


def reliability(df: DataFrame, prob: str, label: str, keys: list[str], bins: int = 10, last_closed: bool = True) -> DataFrame:
    """Count, mean probability and hit rate per probability bin.

    With `last_closed` a probability of 1 belongs to the last bin, otherwise it has no bin.
    """
    b = F.floor(F.col(prob) * bins)
    b = F.least(b, F.lit(bins - 1)) if last_closed else F.when(b < bins, b)
    return (
        df.withColumn("bin", b.cast("int")).filter("bin IS NOT NULL").groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("hit_rate"))
    )


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and maximum calibration error from reliability bins."""
    gap = F.abs(F.col("mean_prob") - F.col("hit_rate"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def one_vs_rest(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per class with its probability and whether it happened."""
    items = F.array(*[F.struct(F.lit(k.upper()).alias("class"), F.col(f"p_{k}").alias("prob"), is_class(k).alias("hit")) for k in CLASSES])
    return df.select(*keep, F.explode(items).alias("_c")).select(*keep, "_c.*")


def confidence(df: DataFrame, keys: list[str], calibration_brier: float = 0.6) -> DataFrame:
    """0.40 spread + 0.35 agreement between models + 0.25 calibration, per match over its models."""
    means = {k: F.avg(f"p_{k}") for k in CLASSES}
    agg = df.groupBy(*keys).agg(*[c.alias(f"m_{k}") for k, c in means.items()], *[F.stddev_samp(f"p_{k}").alias(f"s_{k}") for k in CLASSES])
    spread = 1 - entropy([F.col(f"m_{k}") for k in CLASSES]) / F.ln(F.lit(3.0))
    mean_std = _sum([F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) for k in CLASSES]) / 3
    agreement = F.greatest(1 - mean_std / 0.5, F.lit(0.0))
    score = 0.40 * spread + 0.35 * agreement + 0.25 * max(1 - calibration_brier / 2, 0.0)
    return agg.withColumn("confidence", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def hybrid(p: Column, iso: Column, sigmoid: Column, tail: float = 0.15, middle_isotonic: float = 0.7) -> Column:
    """Sigmoid in the tails, a blend with more isotonic in the middle."""
    in_tail = (p < tail) | (p > 1 - tail)
    return F.when(in_tail, sigmoid).otherwise(middle_isotonic * iso + (1 - middle_isotonic) * sigmoid)


def temperatures(df: DataFrame, keys: list[str], lowest: float = 0.2, highest: float = 5.0, passes: int = 3, points: int = 25) -> DataFrame:
    """Temperature (keys, t) with the lowest log loss of softmax(log p / t), by a grid refined around its best point; all keys in one aggregation a pass."""
    rows = df.select(*keys, "result", *[F.ln(F.greatest(f"p_{k}", F.lit(1e-12))).alias(f"l_{k}") for k in CLASSES])
    at = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (points - 1) for i in range(points)]
    fit = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    fit = fit.select(*keys, F.lit(lowest).alias("_lo"), F.lit(highest).alias("_hi"))
    for _ in range(passes):
        losses = []
        for t in at:
            h, d, a = softmax([F.col(f"l_{k}") / t for k in CLASSES])
            of_result = F.when(F.col("result") == "H", h).when(F.col("result") == "D", d).otherwise(a)
            losses.append(F.avg(-F.ln(F.greatest(of_result, F.lit(1e-15)))))
        side, on = with_suffix(fit, keys)
        found = rows.join(side, on, "inner").groupBy(*keys, "_lo", "_hi").agg(F.array(*losses).alias("_l"))
        best = F.array_position("_l", F.array_min("_l")).cast("int") - 1
        ends = {"_lo": F.greatest(best - 1, F.lit(0)), "_hi": F.least(best + 1, F.lit(points - 1))}
        fit = written(found.select(*keys, *[(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * e / (points - 1)).alias(c) for c, e in ends.items()]), "temperatures")
    return fit.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("t"))


def apply_temperature(df: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Probabilities softened by the temperature of their key; null where the key has none."""
    side, on = with_suffix(fit.withColumnRenamed("t", "_t"), keys)
    probs = softmax([F.ln(F.greatest(F.col(f"p_{k}"), F.lit(1e-12))) / F.col("_t") for k in CLASSES])
    return df.join(side, on, "left").withColumns({f"p_{k}": p for k, p in zip(CLASSES, probs, strict=True)}).select(*df.columns)


def calibrate(train: DataFrame, data: DataFrame, method: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calibrate each class one-vs-rest on `train`, for each value of the keys, and renormalise; method isotonic, platt, hybrid or temperature."""
    by, columns, out = list(keys), data.columns, {}
    if method == "temperature":
        return apply_temperature(data, temperatures(train, by), by)
    rows = one_vs_rest(train, by)
    curves = monotone_curve(rows, [*by, "class"], "prob", "hit") if method != "platt" else None
    sigmoids = sigmoid_curve(rows, [*by, "class"], "prob", "hit") if method != "isotonic" else None
    for k in CLASSES:
        of = F.col("class") == k.upper()
        if curves is not None:
            data = on_curve(data, curves.filter(of), by, f"p_{k}", f"_iso_{k}")
        if sigmoids is not None:
            data = on_sigmoid(data, sigmoids.filter(of), by, f"p_{k}", f"_sig_{k}")
        iso, sig = F.col(f"_iso_{k}"), F.col(f"_sig_{k}")
        out[f"p_{k}"] = hybrid(F.col(f"p_{k}"), iso, sig) if method == "hybrid" else iso if method == "isotonic" else sig
    return renormalise(data.withColumns(out).select(*columns), [f"p_{k}" for k in CLASSES])


# ---------------------------------------------------------------- blending


def blend(preds: DataFrame, weights: dict[str, float], key: str = "match_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of the models that predicted a match, renormalised."""
    w = F.lit(None).cast("double")
    for m, v in weights.items():
        w = F.when(F.col("model") == m, float(v)).otherwise(w)
    weighted = preds.withColumn("_w", w).filter("_w > 0")
    mixed = weighted.groupBy(key, *keep).agg(*[(F.sum(F.col("_w") * F.col(f"p_{k}")) / F.sum("_w")).alias(f"p_{k}") for k in CLASSES])
    return renormalise(mixed, [f"p_{k}" for k in CLASSES])


def override_draws(df: DataFrame, gap: Column, close: float = 50.0, boost: float = 1.1, wide: float = 200.0, cut: float = 0.9) -> DataFrame:
    """Raise draw probabilities of even teams and lower them for uneven ones, then renormalise."""
    f = F.when(F.abs(gap) < close, boost).when(F.abs(gap) > wide, cut).otherwise(1.0)
    return renormalise(df.withColumn("p_d", F.col("p_d") * f), [f"p_{k}" for k in CLASSES])


def weight_grid(models: list[str], step: float = 0.1, low: float = 0.0, high: float = 1.0) -> list[dict[str, float]]:
    """All weight vectors on a grid that sum to 1 and respect the limits per model."""
    n = round(1 / step)
    out = []
    for parts in itertools.product(range(n + 1), repeat=len(models) - 1):
        rest = n - sum(parts)
        if rest < 0:
            continue
        w = [p / n for p in (*parts, rest)]
        if all(low <= v <= high for v in w):
            out.append(dict(zip(models, w, strict=True)))
    return out


def search_weights(preds: DataFrame, grid: list[dict[str, float]], keys: list[str], metric: str = "log_loss") -> DataFrame:
    """Loss of every weight vector: model columns are put side by side once, the grid is one aggregation."""
    models = list(grid[0])
    keep = [*keys, "match_id", "result"]
    wide = preds.groupBy(*keep).agg(
        *[F.max(F.when(F.col("model") == m, F.col(f"p_{k}"))).alias(f"{m}_{k}") for m in models for k in CLASSES]
    )
    aggs = []
    for i, w in enumerate(grid):
        p = {k: _sum([F.lit(float(w[m])) * F.col(f"{m}_{k}") for m in models]) for k in CLASSES}
        if metric == "brier":
            loss = _sum([F.pow(is_class(k) - p[k], F.lit(2.0)) for k in CLASSES])
        else:
            of = F.when(F.col("result") == "H", p["h"]).when(F.col("result") == "D", p["d"]).otherwise(p["a"])
            loss = -F.ln(F.greatest(of, F.lit(1e-15)))
        aggs.append(F.struct(F.lit(i).alias("id"), *[F.lit(float(w[m])).alias(m) for m in models], F.avg(loss).alias("loss")))
    return wide.groupBy(*keys).agg(F.array(*aggs).alias("_g")).select(*keys, F.explode("_g").alias("_x")).select(*keys, "_x.*")


def best_weights(searched: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest loss; the earlier grid point on a tie."""
    others = [c for c in searched.columns if c not in keys]
    return searched.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(F.round("loss", 9), "id")).alias("_r")).select(*keys, "_r.*")
