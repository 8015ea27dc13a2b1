"""Goal distributions and rating formulas as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def poisson_pmf(k: Column, lam: Column) -> Column:
    """exp(-lam) * lam^k / k!; all mass at 0 when lam is not positive."""
    return F.when(lam > 0, F.exp(-lam) * F.pow(lam, k) / F.factorial(k)).otherwise((k == 0).cast("double"))


def poisson_cdf(k: Column, lam: Column) -> Column:
    """Sum of the pmf up to k."""
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + poisson_pmf(i, lam))


def poisson_series(lam: Column, max_goals: int) -> list[Column]:
    """Probabilities of 0..max_goals as separate expressions."""
    factorial = 1.0
    out = []
    for k in range(max_goals + 1):
        factorial *= max(k, 1)
        term = F.exp(-lam) * F.pow(lam, F.lit(float(k))) / F.lit(factorial)
        out.append(F.when(lam > 0, term).otherwise(float(k == 0)))
    return out


def low_score_factor(home: Column, away: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """Correction of the scores 0-0, 0-1, 1-0 and 1-1; 1 elsewhere."""
    return (
        F.when((home == 0) & (away == 0), 1 - lam * mu * rho)
        .when((home == 0) & (away == 1), 1 + lam * rho)
        .when((home == 1) & (away == 0), 1 + mu * rho)
        .when((home == 1) & (away == 1), 1 - rho)
        .otherwise(1.0)
    )


def with_score_markets(
    df: DataFrame, lam: str, mu: str, rho: Column | float = 0.0, max_goals: int = 10, lines: tuple[float, ...] = (2.5, 3.5)
) -> DataFrame:
    """1X2, both-score, over/under and the most likely score from two goal rates, row by row.

    The score grid is never exploded: sums over it are products of the two goal series plus the
    low-score corrections, all inside one projection.
    """
    r = F.lit(rho) if isinstance(rho, float) else rho
    n = max_goals + 1
    base = df.withColumns(
        {f"_h{i}": p for i, p in enumerate(poisson_series(F.col(lam), max_goals))}
        | {f"_a{i}": p for i, p in enumerate(poisson_series(F.col(mu), max_goals))}
        | {"_rho": r}
    )
    h, a = [F.col(f"_h{i}") for i in range(n)], [F.col(f"_a{i}") for i in range(n)]
    cells = {}
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        tau = F.greatest(low_score_factor(F.lit(i), F.lit(j), F.col(lam), F.col(mu), F.col("_rho")), F.lit(0.0))
        cells[(i, j)] = (tau - 1) * h[i] * a[j]
    base = base.withColumns(
        {f"_d{i}{j}": c for (i, j), c in cells.items()}
        | {f"_ca{i}": add(a[: i + 1]) for i in range(n)}
        | {"_sh": add(h), "_sa": add(a)}
    )
    d = {k: F.col(f"_d{k[0]}{k[1]}") for k in cells}
    ca = [F.col(f"_ca{i}") for i in range(n)]
    whole = F.col("_sh") * F.col("_sa") + add(list(d.values()))
    home = add([h[i] * ca[i - 1] for i in range(1, n)]) + d[(1, 0)]
    draw = add([h[i] * a[i] for i in range(n)]) + d[(0, 0)] + d[(1, 1)]
    out = {"_t": whole, "_home": home, "_draw": draw}
    for t in lines:
        top = int(t)
        under = [h[i] * ca[min(top - i, max_goals)] for i in range(min(top, max_goals) + 1)]
        out[f"_u{top}"] = add(under) + add([c for (i, j), c in d.items() if i + j <= top])
    # without the correction the best cell is the best row and the best column; the corrected cells and the cells outside them compete
    def peak(series: list[Column], numbers: range) -> Column:
        return F.array_max(F.array(*[F.struct(series[k].alias("p"), F.lit(-k).alias("k")) for k in numbers]))

    base = base.withColumns({"_h_low": peak(h, range(min(2, n))), "_a_all": peak(a, range(n))} | ({"_h_high": peak(h, range(2, n)), "_a_high": peak(a, range(2, n))} if n > 2 else {}))

    def cell(row: str, column: str) -> Column:
        return F.struct((F.col(f"{row}.p") * F.col(f"{column}.p")).alias("p"), F.col(f"{row}.k").alias("i"), F.col(f"{column}.k").alias("j"))

    grid = F.array(
        *[F.struct((h[i] * a[j] + d[(i, j)]).alias("p"), F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j in d if max(i, j) < n],
        *([cell("_h_high", "_a_all"), cell("_h_low", "_a_high")] if n > 2 else []),
    )
    out["_best"] = F.array_max(grid)
    base = base.withColumns(out)
    t = F.col("_t")
    final = {
        "home_win": F.col("_home") / t,
        "draw": F.col("_draw") / t,
        "away_win": 1 - (F.col("_home") + F.col("_draw")) / t,
        "btts": 1 - F.exp(-F.col(lam)) - F.exp(-F.col(mu)) + F.exp(-F.col(lam) - F.col(mu)),
        "most_likely_score": F.concat_ws("-", (-F.col("_best.i")).cast("string"), (-F.col("_best.j")).cast("string")),
    }
    for line in lines:
        label = str(line).replace(".", "_")
        final[f"over_{label}"] = 1 - F.col(f"_u{int(line)}") / t
    return base.select(*df.columns, *[c.alias(k) for k, c in final.items()])


def expected_points(df: DataFrame, lam: str, mu: str, max_goals: int = 8) -> DataFrame:
    """Expected points of both sides from goal series cut at `max_goals` and normalised."""
    out = with_score_markets(df, lam, mu, 0.0, max_goals, ())
    return out.select(
        *df.columns, (3 * F.col("home_win") + F.col("draw")).alias("h_xpts"), (3 * F.col("away_win") + F.col("draw")).alias("a_xpts")
    )


# ---------------------------------------------------------------- ratings


def elo_expected(home: Column, away: Column, advantage: float = 100.0) -> Column:
    """Expected home score, 1 / (1 + 10^((away - home - advantage) / 400))."""
    return F.lit(1.0) / (1 + F.pow(F.lit(10.0), (away - home - advantage) / 400))


def elo_outcome_probs(expected: Column, draw_share: float = 0.25) -> dict[str, Column]:
    """Draw share shrinks with the gap between the expected scores; the rest is split around it."""
    draw = draw_share * (1 - F.abs(2 * expected - 1))
    return {"home": expected - draw / 2, "draw": draw, "away": 1 - expected - draw / 2}


def elo_btts(home: Column, away: Column) -> Column:
    """Both-score probability with goal rates 1 plus and minus the rating gap over 400, at least 0.1."""
    lam = 1 + (home - away) / 400
    mu = F.greatest(2 - lam, F.lit(0.1))
    lam = F.greatest(lam, F.lit(0.1))
    return F.least(F.greatest(1 - F.exp(-lam) - F.exp(-mu) + F.exp(-lam - mu), F.lit(0.0)), F.lit(1.0))


def elo_k(base: float, goal_margin: Column, xg_margin: Column | None = None, cap: float = 5.0) -> Column:
    """K * ln(1 + margin); the expected-goals margin counts when positive, and a margin of 0 gives K."""

    def grown(m: Column) -> Column:
        return base * F.log1p(F.least(m, F.lit(cap)))

    by_goals = F.when(goal_margin > 0, grown(goal_margin)).otherwise(float(base))
    return by_goals if xg_margin is None else F.when(xg_margin > 0, grown(xg_margin)).otherwise(by_goals)


def elo_framework_k(base: float, margin: Column, importance: Column, tier: Column, cap: float = 5.0) -> Column:
    """K * ln(1 + margin), between half and three times K, times importance and league tier."""
    grown = F.least(F.greatest(F.log1p(F.least(margin, F.lit(cap))), F.lit(0.5)), F.lit(3.0))
    return base * grown * importance * tier


# Match importance by name fragment, most specific first.
MATCH_IMPORTANCE = [
    ("world cup qualifier", 1.2), ("world cup", 1.5), ("continental qualifier", 1.1), ("continental championship", 1.3),
    ("domestic cup", 0.9), ("domestic league", 1.0), ("club friendly", 0.5), ("friendly", 0.6),
]
# League tier factors and the name fragments of the first three tiers.
TIER_FACTORS = {1: 1.0, 2: 1.1, 3: 1.2, 4: 1.3, 5: 1.4}
TIER_NAMES = {
    1: [
        "premier league", "la liga", "serie a", "bundesliga", "ligue 1", "primera division", "eredivisie", "primeira liga",
        "super lig", "mls", "jupiler", "premiership", "first division a", "allsvenskan",
    ],
    2: [
        "championship", "segunda division", "serie b", "2. bundesliga", "ligue 2", "league one", "second division", "superettan",
        "obos ligaen",
    ],
    3: ["league two", "third division", "1. division", "ykkösliiga", "ykkonen"],
}


def match_importance(name: Column) -> Column:
    n = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit(" "))
    out = F.lit(1.0)
    for fragment, factor in reversed(MATCH_IMPORTANCE):
        out = F.when(n.contains(fragment), factor).otherwise(out)
    return out


def tier_factor(name: Column, tier: Column | None = None) -> Column:
    """Factor of a known tier, else of the first tier whose fragments the name contains."""
    n = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit(" "))
    out = F.lit(1.0)
    for t in sorted(TIER_NAMES, reverse=True):
        hit = F.lit(False)
        for fragment in TIER_NAMES[t]:
            hit = hit | n.contains(fragment)
        out = F.when(hit, TIER_FACTORS[t]).otherwise(out)
    if tier is None:
        return out
    known = F.lit(None).cast("double")
    for t, factor in TIER_FACTORS.items():
        known = F.when(tier == t, factor).otherwise(known)
    return F.coalesce(known, out)
