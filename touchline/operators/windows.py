"""As-of windows over series that may be very long.

A window keyed by team (or league, or pair) puts the whole series of a key on one task. Here each
series is cut into calendar blocks. The rows of a block get what they need of the past as a few
extra rows: the last `w` earlier rows for trailing frames, and one row of totals for frames that
reach back to the start. The window then runs on (key, block), so a key that holds a large share
of all rows is spread over as many tasks as it has blocks, and the result is the same.

The input is written once to the shared folder, since rows and carried rows both come from it; so
a chain of such calls evaluates its source once. Blocks are cut finer where the counts ask for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.shared import written

UNITS = ("year", "quarter", "month", "week", "day")
MAX_ROWS = 5_000_000  # rows of a key in one block, at most, down to blocks of one day


@dataclass(frozen=True)
class Trailing:
    """Aggregate of the `rows` rows before the current one; null below `min_count` values."""

    value: Column
    rows: int
    how: str = "avg"
    min_count: int = 1


@dataclass(frozen=True)
class Expanding:
    """Aggregate of all earlier rows of the key."""

    value: Column
    how: str = "avg"


@dataclass(frozen=True)
class Previous:
    """Value of the row `rows` before the current one."""

    value: Column
    rows: int = 1


Feature = Trailing | Expanding | Previous


def pick_unit(df: DataFrame, keys: list[str], date: str, coarsest: str = "year", max_rows: int = MAX_ROWS) -> str:
    """Coarsest calendar unit, from `coarsest` on, at which no (key, block) holds more than `max_rows` rows."""
    if df.count() <= max_rows:
        return coarsest
    units = UNITS[UNITS.index(coarsest) :]
    daily = df.groupBy(*keys, F.to_date(date).alias("_day")).agg(F.count("*").alias("_n"))
    cuts = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), block_of("_day", u).alias("start")) for u in units]))
    per_block = daily.select(*keys, "_n", cuts.alias("_cut")).groupBy(*keys, "_cut").agg(F.sum("_n").alias("_n"))
    most = {r["unit"]: r["n"] for r in per_block.groupBy("_cut.unit").agg(F.max("_n").alias("n")).collect()}
    return next((u for u in units if most.get(u, 0) <= max_rows), units[-1])


def block_of(date: str, unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, F.col(date)))


def with_asof(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    features: dict[str, Feature],
    unit: str = "year",
    block: Column | None = None,
) -> DataFrame:
    """Add one column per feature, computed from rows strictly earlier in `order` within `keys`.

    `order[0]` is the date that gives the block, unless `block` (non-decreasing in `order`) is
    given; `order` as a whole must be a total order per key. `unit` is the coarsest block used.
    """
    names = list(features)
    feats = [features[n] for n in names]
    base = df if block is None else df.withColumn("_block", block)
    base = written(base.withColumns({f"_v{i}": f.value for i, f in enumerate(feats)}), "series")
    if block is None:
        base = base.withColumn("_block", block_of(order[0], pick_unit(base, keys, order[0], unit)))

    trailing = [i for i, f in enumerate(feats) if not isinstance(f, Expanding)]
    expanding = [i for i, f in enumerate(feats) if isinstance(f, Expanding)]
    rows = base.withColumn("_real", F.lit(True))
    for i in expanding:
        rows = rows.withColumn(f"_s{i}", _as_sum(feats[i], F.col(f"_v{i}"))).withColumn(
            f"_n{i}", F.col(f"_v{i}").isNotNull().cast("long")
        )
    if trailing:
        rows = rows.unionByName(
            _tail_rows(base, keys, order, [f"_v{i}" for i in trailing], max(feats[i].rows for i in trailing)),
            allowMissingColumns=True,
        )
    if expanding:
        rows = rows.unionByName(_total_rows(base, keys, {i: feats[i] for i in expanding}), allowMissingColumns=True)

    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = rows.select(
        "*", *[_evaluate(i, f, w).alias(f"_out_{n}") for i, (n, f) in enumerate(zip(names, feats, strict=True))]
    ).filter("_real")
    return out.select(*df.columns, *[F.col(f"_out_{n}").alias(n) for n in names])


def _as_sum(f: Feature, value: Column) -> Column:
    return value.cast("double") if f.how in ("avg", "sum") else value


def _evaluate(i: int, f: Feature, w: Window) -> Column:
    if isinstance(f, Previous):
        return F.lag(f"_v{i}", f.rows).over(w)
    if isinstance(f, Trailing):
        frame = w.rowsBetween(-f.rows, -1)
        value = getattr(F, f.how)(f"_v{i}").over(frame)
        return value if f.min_count <= 1 else F.when(F.count(f"_v{i}").over(frame) >= f.min_count, value)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(f"_n{i}").over(past), F.lit(0))
    if f.how == "count":
        return n
    if f.how in ("max", "min"):
        return getattr(F, f.how)(f"_s{i}").over(past)
    total = F.sum(f"_s{i}").over(past)
    return total if f.how == "sum" else F.try_divide(total, n)


def _tail_rows(base: DataFrame, keys: list[str], order: list[str], values: list[str], width: int) -> DataFrame:
    """For every (key, block): the last `width` rows of the key from earlier blocks.

    The top-k filter is applied before the shuffle, so each block sends at most `width` rows.
    """
    newest = Window.partitionBy(*keys, "_block").orderBy(*[F.col(c).desc() for c in order])
    packed = F.struct(*order, *values)
    tails = (
        base.select(*keys, "_block", *order, *values)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= width)
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("_age"), packed.alias("_row")))).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-width, -1)
    joined = F.flatten(F.collect_list("_tail").over(before))
    carried = tails.select(*keys, "_block", joined.alias("_all")).select(
        *keys,
        "_block",
        F.explode(F.slice("_all", F.greatest(F.size("_all") - width, F.lit(0)) + 1, F.lit(width))).alias("_c"),
    )
    cols = [c for c in [*order, *values] if c not in keys]
    return carried.select(*keys, "_block", *[F.col(f"_c._row.{c}").alias(c) for c in cols], F.lit(False).alias("_real"))


def _total_rows(base: DataFrame, keys: list[str], feats: dict[int, Expanding]) -> DataFrame:
    """For every (key, block): one row with the totals of all earlier blocks; sorts first."""
    fold = {i: (f.how if f.how in ("max", "min") else "sum") for i, f in feats.items()}
    sums = [getattr(F, fold[i])(_as_sum(f, F.col(f"_v{i}"))).alias(f"_s{i}") for i, f in feats.items()]
    counts = [F.count(f"_v{i}").alias(f"_n{i}") for i in feats]
    per_block = base.groupBy(*keys, "_block").agg(*sums, *counts)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys,
        "_block",
        *[getattr(F, fold[i])(f"_s{i}").over(before).alias(f"_s{i}") for i in feats],
        *[F.sum(f"_n{i}").over(before).alias(f"_n{i}") for i in feats],
        F.lit(False).alias("_real"),
    )


def with_ewm(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[Column, float]],
    unit: str = "year",
) -> DataFrame:
    """Exponentially weighted mean of earlier rows: weight 2^(-age/halflife), age counted in rows.

    A null value keeps its place in the ageing but adds nothing. Rows are numbered inside a block
    and cut into segments; every segment takes over the decayed sums of earlier ones, so no
    exponent grows with the series.
    """
    segment_rows = int(40 * min(h for _, h in values.values())) + 1
    reach = int(60 * max(h for _, h in values.values())) + 1
    ids = list(values)
    base = written(df.withColumns({f"_v{i}": values[n][0].cast("double") for i, n in enumerate(ids)}), "series")
    base = base.withColumn("_block", block_of(order[0], pick_unit(base, keys, order[0], unit)))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    base = base.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_seg", F.floor(F.col("_i") / segment_rows)
    ).withColumn("_p", F.col("_i") - F.col("_seg") * segment_rows)

    def grow(i: int, at: Column) -> Column:
        return F.pow(F.lit(2.0), at / F.lit(float(values[ids[i]][1])))

    def weighted(i: int, at: Column) -> list[Column]:
        g = grow(i, at)
        v = F.col(f"_v{i}")
        return [F.sum(v * g), F.sum(F.when(v.isNotNull(), g))]

    seg = base.groupBy(*keys, "_block", "_seg").agg(
        F.count("*").alias("_len"),
        *[c.alias(f"_{t}{i}") for i in range(len(ids)) for t, c in zip("ab", weighted(i, F.col("_p")), strict=True)],
    )
    so_far = Window.partitionBy(*keys).orderBy("_block", "_seg")
    seg = seg.withColumn("_end", F.sum("_len").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    recent = F.collect_list(F.struct("_end", "_len", *[f"_{t}{i}" for i in range(len(ids)) for t in "ab"])).over(
        so_far.rowsBetween(-reach, -1)
    )
    seg = seg.withColumn("_past", recent).withColumn("_start", F.col("_end") - F.col("_len"))

    def carried(i: int, t: str) -> Column:
        def step(acc: Column, s: Column) -> Column:
            shift = s["_end"] - s["_len"] - F.col("_start")
            return acc + F.coalesce(s[f"_{t}{i}"], F.lit(0.0)) * grow(i, shift)

        return F.aggregate("_past", F.lit(0.0), step)

    seg = seg.select(
        *keys, "_block", "_seg", *[carried(i, t).alias(f"_c{t}{i}") for i in range(len(ids)) for t in "ab"]
    )
    past = Window.partitionBy(*keys, "_block", "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(seg, [*keys, "_block", "_seg"])
    cols = []
    for i, n in enumerate(ids):
        num, den = (F.coalesce(c.over(past), F.lit(0.0)) for c in weighted(i, F.col("_p")))
        cols.append(F.try_divide(num + F.col(f"_ca{i}"), den + F.col(f"_cb{i}")).alias(n))
    return out.select(*df.columns, *cols)


def with_decayed_means(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    halflife_days: float,
    block_days: int = 366,
) -> DataFrame:
    """Mean of earlier rows of the key, a row's weight halved every `halflife_days`; equal weights if that is not positive.

    `order[0]` is a date. The days are cut into segments of `block_days` at most, and of 40 halflives at
    most, and weights are counted from the start of a segment; so no weight is larger than 2^40, and a
    segment takes over the sums of earlier ones on the scale of the last of them. A mean is a ratio of
    two sums on the same scale, so it does not depend on how long ago the last row was. Null without earlier rows.
    """
    fades = halflife_days > 0
    span = max(1, min(block_days, int(40 * halflife_days))) if fades else block_days
    ids = list(values)
    base = df.withColumns({f"_v{i}": values[n].cast("double") for i, n in enumerate(ids)})
    base = written(base.withColumn("_day", F.datediff(order[0], F.lit("1970-01-01").cast("date"))), "series")
    base = base.withColumn("_seg", F.floor(F.col("_day") / span))

    def grow(days: Column) -> Column:
        return F.pow(F.lit(2.0), days / float(halflife_days)) if fades else F.lit(1.0)

    base = base.withColumn("_w", grow(F.col("_day") - F.col("_seg") * span))
    weighted = {f"_s{i}": F.col("_w") * F.col(f"_v{i}") for i in range(len(ids))}
    weighted |= {f"_n{i}": F.when(F.col(f"_v{i}").isNotNull(), F.col("_w")) for i in range(len(ids))}
    seg = base.groupBy(*keys, "_seg").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in weighted.items()])
    reach = int(60 * halflife_days / span) + 1 if fades else None
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding if reach is None else -reach, -1)
    if fades:
        last = F.element_at("_past", -1)["_seg"]

        def carried(name: str) -> Column:
            return F.aggregate("_past", F.lit(0.0), lambda acc, p: acc + p[name] * grow((p["_seg"] - last) * span))

        past = seg.withColumn("_past", F.collect_list(F.struct("_seg", *weighted)).over(before)).filter(F.size("_past") > 0)
        carry = past.select(*keys, "_seg", last.alias("_last"), *[carried(n).alias(f"_c{n}") for n in weighted])
    else:
        carry = seg.select(*keys, "_seg", F.col("_seg").alias("_last"), *[F.sum(n).over(before).alias(f"_c{n}") for n in weighted])
    out = base.join(carry, [*keys, "_seg"], "left")
    here = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(grow((F.col("_last") - F.col("_seg")) * span), F.lit(0.0))

    def sums(i: int) -> list[Column]:
        now = [F.coalesce(F.sum(weighted[f"_{t}{i}"]).over(here), F.lit(0.0)) for t in "sn"]
        return [*now, *[F.coalesce(f"_c_{t}{i}", F.lit(0.0)) for t in "sn"]]

    means = []
    for i, n in enumerate(ids):
        s, c, cs, cn = sums(i)
        means.append(F.when(c > 0, (s + cs * shift) / (c + cn * shift)).otherwise(F.try_divide(cs, cn)).alias(n))
    return out.select(*df.columns, *means)


def with_row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "row_index", unit: str = "month") -> DataFrame:
    """Zero-based position of each row in `order`, per key or (no keys) over the whole frame."""
    by = list(keys) or ["_all"]
    framed = df if keys else df.withColumn("_all", F.lit(1))
    out = with_asof(framed, by, order, {name: Expanding(F.lit(1), "count")}, unit)
    return out.select(*df.columns, name)
