"""Attack and defence strengths fitted to goals or expected goals, and predictions from them.

The weighted likelihood only needs, for each ordered pair of teams, sums of weights, of weighted goals and of low scores. These are
aggregated first, so the fit itself sees one row per pair that met, however many matches there are, and runs as sums by team.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import goals as G
from touchline.operators.clean import recency_weight
from touchline.operators.form import ORDER
from touchline.operators.windows import with_decayed_means, with_row_index
from touchline.sources.shared import written

LOW = ("w00", "w01", "w10", "w11")
BOUND, HOME_BOUND, RHO_BOUND = 3.0, 2.0, 0.5
ROUNDS, TOLERANCE = 60, 1e-7


def pair_sums(matches: DataFrame, home: str = "home_goals", away: str = "away_goals", weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a fit needs: per (keys, home_team, away_team) the weight `w`, the weighted goals `hg` and `ag`, and the weight of each low score.

    Matches without goals, teams or a positive weight are left out. The rows grow with the pairs that met, not with the matches.
    """
    g, c, w = F.col(home).cast("double"), F.col(away).cast("double"), weight if weight is not None else F.lit(1.0)
    rows = matches.select(*keys, "home_team", "away_team", g.alias("_g"), c.alias("_c"), w.cast("double").alias("_w")).filter(
        "_g IS NOT NULL AND _c IS NOT NULL AND _w > 0 AND home_team IS NOT NULL AND away_team IS NOT NULL"
    )
    low = [F.sum(F.when((F.col("_g") == i) & (F.col("_c") == j), F.col("_w")).otherwise(0.0)).alias(f"w{i}{j}") for i in (0, 1) for j in (0, 1)]
    return rows.groupBy(*keys, "home_team", "away_team").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_g")).alias("hg"), F.sum(F.col("_w") * F.col("_c")).alias("ag"), *low)


def _rated_pairs(pairs: DataFrame, teams: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with both rates, and with the slopes `th` and `ta` of the low-score correction along the log of either rate."""
    out = pairs
    for side, c in (("home", "h"), ("away", "a")):
        shared = ["gamma", "rho"] if c == "h" else []
        out = out.join(teams.selectExpr(*keys, f"team AS {side}_team", f"alpha AS {c}a", f"beta AS {c}b", f"kind AS {c}f", f"moved AS {c}m", *shared), [*keys, f"{side}_team"])
    out = out.selectExpr("*", "exp(ha + ab + gamma) AS lam", "exp(aa + hb) AS mu")
    none = "w00 * -lam * mu * rho / greatest(1 - lam * mu * rho, 1e-10D)"
    return out.selectExpr("*", f"{none} + w01 * lam * rho / greatest(1 + lam * rho, 1e-10D) AS th", f"{none} + w10 * mu * rho / greatest(1 + mu * rho, 1e-10D) AS ta")


def _by_team(rated: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per team, for its attack (`alpha`) or its defence (`beta`): goals `g`, fitted goals `r`, slope `t`, and its parameters."""
    scored, conceded = ("h", "a") if column == "alpha" else ("a", "h")
    side = "struct({0}_team AS team, {1} AS g, w * {2} AS r, {3} AS t, {4}a AS alpha, {4}b AS beta, {4}f AS kind, {4}m AS moved)"
    name = {"h": "home", "a": "away"}
    both = f"explode(array({side.format(name[scored], 'hg', 'lam', 'th', scored)}, {side.format(name[conceded], 'ag', 'mu', 'ta', conceded)})) AS s"
    rows = rated.selectExpr(*keys, "gamma", "rho", both).selectExpr(*keys, "gamma", "rho", "s.*")
    return rows.groupBy(*keys, "team").agg(*[F.sum(c).alias(c) for c in "grt"], *[F.max(c).alias(c) for c in ("alpha", "beta", "kind", "gamma", "rho", "moved")])


def _team_step(pairs: DataFrame, teams: DataFrame, keys: list[str], column: str, ridge: float) -> DataFrame:
    """One parameter of every team moved to where its goals, fitted goals and penalty balance, all else kept."""
    sums = _by_team(_rated_pairs(pairs, teams, keys), keys, column)
    gap = f"(g + t - r * exp(d) - {2 * ridge}D * ({column} + d)) / (r * exp(d) + {2 * ridge + 1e-12}D)"
    moved = f"aggregate(sequence(1, 12), 0D, (d, i) -> d + greatest(-1D, least(1D, {gap})))"
    fresh = sums.selectExpr("*", f"CASE WHEN kind = 0 THEN {column} ELSE greatest(-{BOUND}D, least({BOUND}D, {column} + {moved})) END AS fresh")
    kept = [c if c != column else f"fresh AS {c}" for c in ("alpha", "beta", "kind", "gamma", "rho")]
    return written(fresh.selectExpr(*keys, "team", *kept, f"greatest(moved, abs(fresh - {column})) AS moved"), "strengths")


#: Kind of the attacking and of the defending team (0 reference, 1 plays at home too, 2 only away), and whether the goals are the home team's.
_CLASSES = [(x, y, z) for x in (0, 1, 2) for y in (0, 1, 2) for z in (0, 1)]
_SHIFTS = ("a1", "a2", "b1", "b2")


def _shared_step(pairs: DataFrame, teams: DataFrame, keys: list[str], ridge: float, with_rho: bool) -> DataFrame:
    """Per key: the home effect, a common shift of the attacks and of the defences of each kind of team, and the low-score correlation.

    Single teams move along these only slowly. The shifts need no more than sums by kinds, so their Newton steps run on one row per key.
    """
    rated = _rated_pairs(pairs, teams, keys)
    sums = {}
    for x, y, z in _CLASSES:
        attack, defence, rate, goals = ("hf", "af", "lam", "hg + th") if z else ("af", "hf", "mu", "ag + ta")
        here = f"{attack} = {x} AND {defence} = {y}"
        sums |= {f"r{x}{y}{z}": f"sum(CASE WHEN {here} THEN w * {rate} ELSE 0D END)", f"g{x}{y}{z}": f"sum(CASE WHEN {here} THEN {goals} ELSE 0D END)"}
    ratios = {w: f"{x} / greatest(1 + {x} * rho, 1e-10D)" for w, x in (("w00", "(-lam * mu)"), ("w01", "lam"), ("w10", "mu"), ("w11", "(-1D)"))}
    sums |= {"slope": "sum(" + " + ".join(f"{w} * {r}" for w, r in ratios.items()) + ")", "bend": "sum(" + " + ".join(f"{w} * pow({r}, 2)" for w, r in ratios.items()) + ")"}
    sums |= {"most": "max(lam * mu)", "widest": "max(greatest(lam, mu))", "gamma": "max(gamma)", "rho": "max(rho)"}
    of = [(name, "alpha" if name[0] == "a" else "beta", name[1]) for name in _SHIFTS]
    totals = [F.expr(f"sum(CASE WHEN kind = {k} THEN {c} ELSE 0D END) AS s_{n}") for n, c, k in of] + [F.expr(f"CAST(count_if(kind = {k}) AS DOUBLE) AS n_{n}") for n, _, k in of]
    penalty = teams.groupBy(*keys).agg(*totals, F.max("moved").alias("of_teams"))
    held = rated.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in sums.items()]).join(penalty, keys)
    schema = ", ".join(f"`{k}` {t}" for k, t in held.select(*keys).dtypes)
    return written(held.mapInPandas(lambda parts: (_shifted(p, keys, ridge, with_rho) for p in parts), f"{schema}, gamma double, rho double, " + ", ".join(f"d{n} double" for n in _SHIFTS) + ", moved double"), "effects")


def _shifted(p: pd.DataFrame, keys: list[str], ridge: float, with_rho: bool, steps: int = 20) -> pd.DataFrame:
    """New shared parameters of many keys, a row each."""
    on = np.array([[x == 1, x == 2, y == 1, y == 2, z == 1] for x, y, z in _CLASSES], float)
    r, g = (p[[f"{c}{x}{y}{z}" for x, y, z in _CLASSES]].to_numpy(float) for c in "rg")
    count, total = (np.column_stack([p[[f"{c}_{n}" for n in _SHIFTS]].to_numpy(float), np.zeros(len(p))]) for c in ("n", "s"))
    at = np.zeros((len(p), on.shape[1]))
    for _ in range(steps):
        fitted = r * np.exp(at @ on.T)
        slope = (g - fitted) @ on - 2 * ridge * (total + count * at)
        bend = np.einsum("kc,ci,cj->kij", fitted, on, on) + (2 * ridge * count + 1e-9)[:, :, None] * np.eye(on.shape[1])
        at += np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -0.5, 0.5)
    rho = p["rho"].to_numpy(float)
    if with_rho:
        step = np.clip(p["slope"].to_numpy(float) / (p["bend"].to_numpy(float) + 1e-12), -0.1, 0.1)
        rho = np.clip(np.minimum(np.maximum(rho + step, -0.95 / p["widest"]), 0.95 / p["most"]), -RHO_BOUND, RHO_BOUND)
    moved = np.column_stack([p["of_teams"], np.abs(at), np.abs(rho - p["rho"])]).max(axis=1)
    return p[keys].assign(gamma=np.clip(p["gamma"] + at[:, -1], -HOME_BOUND, HOME_BOUND), rho=rho, **{f"d{n}": at[:, i] for i, n in enumerate(_SHIFTS)}, moved=moved)


def fit_goal_models(
    pairs: DataFrame, keys: list[str], ridge: float = 0.0, with_rho: bool = True, start: DataFrame | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """(keys, team, alpha, beta, kind, gamma, rho) with the highest likelihood, for all keys at once; gamma and rho are those of the key.

    log lam = alpha[home] + beta[away] + gamma, log mu = alpha[away] + beta[home], low scores corrected by rho. The first team by name of a
    key is the reference with both parameters 0 (kind 0; 1 plays at home, 2 only away). The fit is coordinate ascent: attacks, defences, then what all share, each a sum over
    the pairs by team or key, so a model may have any number of teams and pairs; only the largest move of a round reaches the driver.
    `start` has earlier parameters to go on from; teams that it lacks begin at 0.
    """
    pairs = pairs.select(*keys, "home_team", "away_team", "w", "hg", "ag", *(LOW if with_rho else [F.lit(0.0).alias(c) for c in LOW]))
    sides = F.explode(F.array(F.struct(F.col("home_team").alias("team"), F.lit(1).alias("kind")), F.struct(F.col("away_team").alias("team"), F.lit(2).alias("kind"))))
    names = pairs.select(*keys, sides.alias("s")).groupBy(*keys, "s.team").agg(F.min("s.kind").alias("kind"))
    first = pairs.groupBy(*keys).agg(F.min(F.least("home_team", "away_team")).alias("_first"), F.expr("ln(greatest(sum(hg), 0.1D) / greatest(sum(ag), 0.1D)) AS gamma"))
    teams = names.join(first, keys).selectExpr(*keys, "team", "0D AS alpha", "0D AS beta", "CASE WHEN team = _first THEN 0 ELSE kind END AS kind", f"greatest(-{HOME_BOUND}D, least({HOME_BOUND}D, gamma)) AS gamma", "0D AS rho", "0D AS moved")
    if start is not None:
        old = start.selectExpr(*keys, "team", "alpha AS _a", "beta AS _b")
        shared = start.groupBy(*keys).agg(F.max("gamma").alias("_g"), F.max("rho").alias("_r"))
        kept = [f"CASE WHEN kind = 0 THEN 0D ELSE coalesce(_{c[0]}, 0D) END AS {c}" for c in ("alpha", "beta")]
        teams = teams.join(old, [*keys, "team"], "left").join(shared, keys, "left").selectExpr(*keys, "team", *kept, "kind", "coalesce(_g, gamma) AS gamma", "coalesce(_r, rho) AS rho", "moved")
    teams = written(teams, "strengths")
    moves: list[DataFrame] = []
    for k in range(rounds):
        before = teams
        for column in ("alpha", "beta"):
            teams = _team_step(pairs, teams, keys, column, ridge)
        effects = _shared_step(pairs, teams, keys, ridge, with_rho)
        shifted = [f"CASE kind WHEN 0 THEN {c} ELSE greatest(-{BOUND}D, least({BOUND}D, {c} + CASE kind WHEN 1 THEN d{c[0]}1 ELSE d{c[0]}2 END)) END AS {c}" for c in ("alpha", "beta")]
        teams = teams.drop("gamma", "rho", "moved").join(effects.drop("moved"), keys).selectExpr(*keys, "team", *shifted, "kind", "gamma", "rho", "0D AS moved")
        moves = [*moves[-2:], effects]
        if (effects.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
        if k % 4 == 3:
            teams = _carried_on(teams, before, moves, keys)
    return teams.drop("moved")


def _carried_on(teams: DataFrame, before: DataFrame, moves: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parameters moved to where their last moves lead, for keys whose rounds shrink them at a steady rate."""
    rate = functools.reduce(lambda a, b: a.join(b, keys), [m.selectExpr(*keys, f"moved AS m{i}") for i, m in enumerate(moves)])
    rate = rate.selectExpr(*keys, "CASE WHEN abs(m2 / m1 - m1 / m0) < 0.1 AND m2 / m1 BETWEEN 0.2 AND 0.97 THEN m2 / (m1 - m2) ELSE 0D END AS jump")
    old = before.selectExpr(*keys, "team", "alpha AS a0", "beta AS b0", "gamma AS g0")
    on = [f"{c} + jump * ({c} - {c[0]}0) AS {c}" for c in ("alpha", "beta", "gamma")]
    return written(teams.join(old, [*keys, "team"]).join(rate, keys).selectExpr(*keys, "team", "kind", *on, "rho", "0D AS moved"), "strengths")


def balances(pairs: DataFrame, teams: DataFrame, keys: list[str], ridge: float = 0.0) -> DataFrame:
    """Per team: goals scored and conceded, and what is left of either after fitted goals, correction and penalty.

    At the highest likelihood nothing is left, but for the reference team (null) and for parameters at their bounds (null).
    """
    rated = _rated_pairs(pairs, teams.withColumn("moved", F.lit(0.0)), keys)
    sides = []
    for column, goals in (("alpha", "scored"), ("beta", "conceded")):
        left = f"CASE WHEN kind > 0 AND abs({column}) < {BOUND}D THEN g + t - r - {2 * ridge}D * {column} END AS {goals}_left"
        sides.append(_by_team(rated, keys, column).selectExpr(*keys, "team", *(["alpha", "beta"] if column == "alpha" else []), f"g AS {goals}", left))
    return sides[0].join(sides[1], [*keys, "team"])


def with_rates(fixtures: DataFrame, strengths: DataFrame, gamma: Column | float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Goal rates of both sides; teams without parameters count as the reference."""
    out = fixtures
    for side in ("home", "away"):
        named = strengths.select(*keys, F.col("team").alias(f"{side}_team"), F.col("alpha").alias(f"{side}_alpha"), F.col("beta").alias(f"{side}_beta"))
        out = out.join(named, [*keys, f"{side}_team"], "left").fillna(0.0, subset=[f"{side}_alpha", f"{side}_beta"])
    g = F.lit(gamma) if isinstance(gamma, float) else gamma
    return out.withColumns(
        {"lam": F.exp(F.col("home_alpha") + F.col("away_beta") + g), "mu": F.exp(F.col("away_alpha") + F.col("home_beta"))}
    )


RHO_GRID = [round(-0.5 + 0.005 * i, 3) for i in range(201)]


def fit_rho(rated: DataFrame, weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Low-score correlation with the highest weighted likelihood over a grid.

    Only the four low scores depend on it; they are summed per pair of rates first, so the grid
    is tried on at most four rows per pair of teams.
    """
    w = weight if weight is not None else F.lit(1.0)
    low = rated.filter("home_goals <= 1 AND away_goals <= 1").groupBy(*keys, "home_goals", "away_goals", "lam", "mu").agg(F.sum(w).alias("_w"))
    tried = low.withColumn("rho", F.explode(F.array(*[F.lit(r) for r in RHO_GRID])))
    tau = F.greatest(G.low_score_factor(F.col("home_goals"), F.col("away_goals"), F.col("lam"), F.col("mu"), F.col("rho")), F.lit(1e-10))
    fit = tried.groupBy(*keys, "rho").agg(F.sum(F.col("_w") * F.log(tau)).alias("ll"))
    return fit.groupBy(*keys).agg(F.max_by("rho", F.struct("ll", -F.abs("rho"))).alias("rho"))


def score_table(rated: DataFrame, rho: Column | float = 0.0, max_goals: int = 6, keep: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """One row per match and score with its normalised probability."""
    r = F.lit(rho) if isinstance(rho, float) else rho
    cell = F.explode(F.sequence(F.lit(0), F.lit((max_goals + 1) ** 2 - 1)))
    out = rated.select(*keep, "lam", "mu", r.alias("rho"), F.array(*G.poisson_series(F.col("lam"), max_goals)).alias("h"), F.array(*G.poisson_series(F.col("mu"), max_goals)).alias("a"))
    i, j = F.floor(F.col("_c") / (max_goals + 1)).cast("int"), (F.col("_c") % (max_goals + 1)).cast("int")

    def p(i: Column, j: Column) -> Column:
        return F.greatest(F.get("h", i) * F.get("a", j) * G.low_score_factor(i, j, F.col("lam"), F.col("mu"), F.col("rho")), F.lit(0.0))

    n = max_goals + 1
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0.0), lambda acc, c: acc + p(F.floor(c / n).cast("int"), (c % n).cast("int")))
    return (
        out.withColumn("_whole", whole)
        .withColumn("_c", cell)
        .select(*keep, i.alias("home_score"), j.alias("away_score"), (p(i, j) / F.col("_whole")).alias("probability"))
    )


def poisson_as_of(matches: DataFrame, halflife_days: float = 180.0, pool: str | None = None) -> DataFrame:
    """Attack and defence strengths and goal rates before each match from means that fade by 2^(-days / halflife).

    Teams and pools run over segments of days, a week of a pool at a time.
    """
    base = matches.select(
        (F.col(pool).cast("string") if pool else F.lit("all")).alias("pool"), "match_date", "match_id", "home_team", "away_team",
        F.coalesce("home_goals", F.lit(0)).alias("hg"), F.coalesce("away_goals", F.lit(0)).alias("ag"),
    )
    league = with_decayed_means(base, ["pool"], ORDER, {"_lh": F.col("hg"), "_la": F.col("ag")}, halflife_days, 7)
    sides = F.explode(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.col("hg").alias("s"), F.col("ag").alias("c"), F.lit("h").alias("side")),
            F.struct(F.col("away_team").alias("team"), F.col("ag").alias("s"), F.col("hg").alias("c"), F.lit("a").alias("side")),
        )
    )
    team = with_decayed_means(
        base.select("pool", "match_date", "match_id", sides.alias("g")).select("pool", "match_date", "match_id", "g.*"),
        ["pool", "team"], ORDER, {"_s": F.col("s"), "_c": F.col("c")}, halflife_days,
    )

    def of(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))

    per_match = team.groupBy("match_id").agg(of("h", "_s").alias("_hs"), of("h", "_c").alias("_hc"), of("a", "_s").alias("_as"), of("a", "_c").alias("_ac"))
    out = league.join(per_match, "match_id")
    out = out.withColumns({"_mh": F.coalesce("_lh", F.lit(0.0)), "_ma": F.coalesce("_la", F.lit(0.0))}).withColumn("_mu", (F.col("_mh") + F.col("_ma")) / 2)

    def strength(c: str) -> Column:
        return F.when((F.col("_mu") > 0) & F.col(c).isNotNull(), F.col(c) / F.col("_mu")).otherwise(1.0)

    out = out.withColumns({"home_attack": strength("_hs"), "home_defence": strength("_hc"), "away_attack": strength("_as"), "away_defence": strength("_ac")})
    out = out.withColumns(
        {
            "expected_home_goals": F.col("_mh") * F.col("home_attack") * F.col("away_defence"),
            "expected_away_goals": F.col("_ma") * F.col("away_attack") * F.col("home_defence"),
        }
    )
    return out.select(
        "match_id", "expected_home_goals", "expected_away_goals",
        (F.col("expected_home_goals") + F.col("expected_away_goals")).alias("expected_total_goals"),
        (F.col("expected_home_goals") - F.col("expected_away_goals")).alias("expected_goal_difference"),
        "home_attack", "home_defence", "away_attack", "away_defence",
    )


def predict_poisson(matches: DataFrame, strengths: DataFrame, averages: DataFrame, max_goals: int = 10) -> DataFrame:
    """Markets from team strengths relative to the scoring average (independent scores).

    `averages` is one row with mean home and away goals.
    """
    out = matches
    for side in ("home", "away"):
        named = strengths.select(F.col("team").alias(f"{side}_team"), F.col("attack").alias(f"{side}_attack"), F.col("defence").alias(f"{side}_defence"))
        out = out.join(named, f"{side}_team", "left").fillna(1.0, subset=[f"{side}_attack", f"{side}_defence"])
    mh, ma = averages.select("home").scalar(), averages.select("away").scalar()
    out = out.withColumns(
        {"lam": mh * F.col("home_attack") * F.col("away_defence"), "mu": ma * F.col("away_attack") * F.col("home_defence")}
    )
    return G.with_score_markets(out, "lam", "mu", 0.0, max_goals)


def per_league_rates(matches: DataFrame, min_matches: int = 50, halflife_days: float = 365.0, ridge: float = 0.02) -> DataFrame:
    """Goal rates from a model of the match's own league, or from the global one (`*`) where the league is small. All models are fitted together."""
    last = matches.agg(F.date_add(F.max("match_date"), 1)).scalar()
    dated = matches.withColumn("_ref", last)
    w = recency_weight(F.col("match_date"), F.col("_ref"), halflife_days)
    own = written(pair_sums(dated, weight=w, keys=("league",)).withColumnRenamed("league", "model_league"), "pairs")
    whole = own.groupBy("home_team", "away_team").agg(*[F.sum(c).alias(c) for c in ("w", "hg", "ag", *LOW)]).withColumn("model_league", F.lit("*"))
    pairs = written(own.filter("model_league IS NOT NULL").unionByName(whole), "pairs")
    teams = fit_goal_models(pairs, ["model_league"], ridge)
    counts = matches.groupBy("league").agg((F.count("*") >= min_matches).alias("_own"))
    chosen = matches.join(counts, "league").withColumn("model_league", F.when(F.col("_own"), F.col("league")).otherwise("*"))
    chosen = chosen.join(teams.groupBy("model_league").agg(F.max("gamma").alias("gamma"), F.max("rho").alias("rho")), "model_league")
    return with_rates(chosen, teams, F.col("gamma"), ("model_league",)).drop("_own")


def refit_blocks(matches: DataFrame, every: int, most: int = 5000, unit: str = "month") -> DataFrame:
    """Adds `block`: matches in order of date and id; blocks begin after `every` matches and grow twice as long up to `most`, days stay whole.

    A day belongs to the block in which its first match falls.
    """
    sizes = []
    while not sizes or sizes[-1] < most:
        sizes.append(min(every * 2 ** len(sizes), most))
    starts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    row = F.col("_row")
    block = F.lit(0)
    for i, at in enumerate(starts[1:], 1):
        block = F.when(row >= at, F.lit(i)).otherwise(block)
    block = F.when(row >= starts[-1], len(sizes) + F.floor((row - starts[-1]) / most)).otherwise(block).cast("long")
    days = with_row_index(matches, [], list(ORDER), "_row", unit).groupBy("match_date").agg(F.min("_row").alias("_row")).select("match_date", block.alias("block"))
    return matches.join(days, "match_date")


def sums_before_blocks(matches: DataFrame, halflife_days: float) -> DataFrame:
    """(block, home_team, away_team, sums): the pair sums of all blocks before `block`, faded to its start.

    Each pair's sums are handed on from the block where it met to the next one where it meets, so a match is read once; a row follows for
    each pair that has met and each block. Only the calendar of blocks reaches the driver.
    """
    sums = ["w", "hg", "ag", *LOW]
    calendar = [(r["block"], r["start"]) for r in matches.filter("block IS NOT NULL").groupBy("block").agg(F.min("match_date").alias("start")).orderBy("start", "block").collect()]
    kind = matches.schema["block"].dataType
    order = F.create_map(*[F.lit(x) for i, (b, _) in enumerate(calendar) for x in (b, i)]) if calendar else F.create_map()
    starts = F.array(*[F.lit(d).cast("date") for _, d in calendar])
    names = F.array(*[F.lit(b).cast(kind) for b, _ in calendar])
    placed = matches.withColumn("_i", F.try_element_at(order, F.col("block")) if calendar else F.lit(None).cast("int")).filter(F.col("_i") < len(calendar) - 1)
    # weights are counted to the start of the next block, the first that may use them
    placed = placed.withColumn("_next", F.get(starts, F.col("_i") + 1))
    met = pair_sums(placed, weight=recency_weight(F.col("match_date"), F.col("_next"), halflife_days), keys=("_i", "_next"))
    w = Window.partitionBy("home_team", "away_team").orderBy("_i")
    past = F.collect_list(F.struct("_next", *sums)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = met.select("home_team", "away_team", "_i", "_next", past.alias("_past"), F.lead("_i").over(w).alias("_until"))

    def total(c: str) -> Column:
        return F.aggregate("_past", F.lit(0.0), lambda acc, x: acc + x[c] * recency_weight(x["_next"], F.col("_next"), halflife_days))

    held = held.select("home_team", "away_team", "_next", *[total(c).alias(c) for c in sums], F.explode(F.sequence(F.col("_i") + 1, F.coalesce("_until", F.lit(len(calendar) - 1)))).alias("_b"))
    fade = recency_weight(F.col("_next"), F.get(starts, F.col("_b")), halflife_days)
    return held.select(F.get(names, F.col("_b")).alias("block"), "home_team", "away_team", *[(F.col(c) * fade).alias(c) for c in sums])


def as_of_rates(matches: DataFrame, block: Column, halflife_days: float = 365.0, ridge: float = 0.02, with_rho: bool = True) -> DataFrame:
    """Goal rates of every match from a model that saw only blocks before its own, with its gamma and rho; null in the first block.

    `block` must not fall as dates rise. The models of all blocks are fitted together from the sums handed on by `sums_before_blocks`.
    """
    tagged = matches.withColumn("block", block)
    pairs = written(sums_before_blocks(tagged, halflife_days), "pairs")
    strengths = fit_goal_models(pairs, ["block"], ridge, with_rho)
    effects = strengths.groupBy("block").agg(F.max("gamma").alias("gamma"), F.max("rho").alias("rho"))
    rated = with_rates(tagged.join(effects, "block", "left"), strengths, F.col("gamma"), ("block",))
    return rated.withColumns({c: F.when(F.col("gamma").isNotNull(), F.col(c)) for c in ("lam", "mu")})
