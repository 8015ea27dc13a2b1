"""Bookmaker-market features: movement, consensus, best prices, spreads, arbitrage, closing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import odds as O
from touchline.operators.windows import with_row_index

SIDES = {"h": "home", "d": "draw", "a": "away"}


def _fair(prefix: str) -> tuple[Column, dict[str, Column]]:
    """Margin (null when not positive) and fair probabilities (null with it) of one price triple."""
    cols = [F.col(f"{prefix}_{k}") for k in SIDES]
    m = O.margin(cols)
    m = F.when(m > 0, m)
    return m, {k: O.implied(F.col(f"{prefix}_{k}")) / (1 + m) for k in SIDES}


def odds_features(df: DataFrame, opening: str = "odds", closing: str = "close") -> DataFrame:
    """Fair probabilities, movement, favourite, confidence, fair-price shift and margins of opening and closing odds."""
    mo, fo = _fair(opening)
    mc, fc = _fair(closing)
    out = df.withColumns(
        {"margin_opening": mo, "margin_closing": mc}
        | {f"fair_{n}_opening": fo[k] for k, n in SIDES.items()}
        | {f"fair_{n}_closing": fc[k] for k, n in SIDES.items()}
    )
    top = F.greatest(*[F.col(f"fair_{n}_closing") for n in SIDES.values()])
    low = F.least(*[F.col(f"fair_{n}_closing") for n in SIDES.values()])

    def which(best: Column) -> Column:
        return (
            F.when(F.col("fair_home_closing") == best, "H").when(F.col("fair_draw_closing") == best, "D").when(F.col("fair_away_closing") == best, "A")
        )

    moves: dict[str, Column] = {}
    for k, n in SIDES.items():
        o, c = F.col(f"{opening}_{k}"), F.col(f"{closing}_{k}")
        moves[f"movement_{n}"] = c - o
        moves[f"movement_pct_{n}"] = F.when(o > 0, (c - o) / o * 100)
        moves[f"clv_{n}"] = F.col(f"fair_{n}_closing") - F.col(f"fair_{n}_opening")
    return out.withColumns(
        {"market_favorite": which(top), "market_underdog": which(low), "market_confidence": top} | moves
    ).withColumns({f"is_{n}_favorite": (F.col("market_favorite") == n[0].upper()).cast("int") for n in ("home", "away")})


def fair_quotes(books: DataFrame) -> DataFrame:
    """Bookmaker quotes with fair probabilities; quotes without a positive margin get nulls."""
    _, f = _fair("odds")
    return books.withColumns({f"fair_{k}": f[k] for k in SIDES})


def consensus(books: DataFrame) -> DataFrame:
    """Mean fair probability per match over the bookmakers that quote it."""
    return fair_quotes(books).groupBy("match_id").agg(
        F.count("*").alias("bookmakers"), *[F.avg(f"fair_{k}").alias(f"consensus_{n}") for k, n in SIDES.items()]
    )


def volatility(books: DataFrame) -> DataFrame:
    """Mean over outcomes of the spread (standard deviation) of fair probabilities between bookmakers."""
    return fair_quotes(books).groupBy("match_id").agg(*[F.stddev_samp(f"fair_{k}").alias(k) for k in SIDES]).select(
        "match_id", ((F.col("h") + F.col("d") + F.col("a")) / 3).alias("odds_volatility")
    )


def best_odds(books: DataFrame) -> DataFrame:
    """Highest price per outcome and who offers it; the first bookmaker by name wins ties."""
    aggs = []
    for k in SIDES:
        best = F.min(F.struct((-F.col(f"odds_{k}")).alias("p"), F.col("bookmaker").alias("b")))
        aggs += [F.max(f"odds_{k}").alias(f"best_{k}"), best.getField("b").alias(f"best_{k}_bookmaker")]
    return books.groupBy("match_id").agg(*aggs)


def arbitrage(best: DataFrame, total_stake: float = 100.0) -> DataFrame:
    """Matches whose best prices sum to less than one implied, with the profit and the stake split."""
    book = O.total([O.implied(F.col(f"best_{k}")) for k in SIDES])
    out = best.withColumn("implied_total", book).filter("implied_total < 1")
    return out.select(
        "match_id", "implied_total", ((1 / F.col("implied_total") - 1) * 100).alias("arbitrage_pct"),
        *[(F.lit(total_stake) / F.col(f"best_{k}") / F.col("implied_total")).alias(f"stake_{k}") for k in SIDES],
    )


def bookmaker_spreads(books: DataFrame) -> DataFrame:
    """Highest minus lowest price per outcome."""
    spreads = [(F.max(f"odds_{k}") - F.min(f"odds_{k}")).alias(f"spread_{k}") for k in SIDES]
    out = books.groupBy("match_id").agg(F.count("*").alias("bookmakers"), *spreads)
    return out.withColumn("max_disagreement", F.greatest(*[f"spread_{k}" for k in SIDES]))


def closing_line_bets(books: DataFrame) -> DataFrame:
    """Quotes as bets on each outcome with their closing-line value, in long form."""
    sides = F.explode(
        F.array(*[F.struct(F.lit(k.upper()).alias("outcome"), F.col(f"odds_{k}").alias("taken"), F.col(f"close_{k}").alias("closing")) for k in SIDES])
    )
    out = books.select("match_id", "bookmaker", "quoted_on", sides.alias("s")).select("match_id", "bookmaker", "quoted_on", "s.*")
    return out.withColumn("clv", O.clv_price(F.col("taken"), F.col("closing")))


def clv_summary(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Closing-line summary per key. The values are rounded, so the median keeps a bounded set of them."""
    clv = F.col("clv")
    n = F.count("*")
    aggs = [
        n.alias("total_bets"),
        F.count_if(F.col("closing") > 1).alias("n_with_closing"),
        F.count_if(F.col("closing").isNull() | (F.col("closing") <= 1)).alias("n_missing_closing"),
        F.avg("clv").alias("avg_clv"),
        F.median("clv").alias("median_clv"),
        F.stddev_samp("clv").alias("std_clv"),
        F.min("clv").alias("min_clv"),
        F.max("clv").alias("max_clv"),
    ]
    for name, test in (("positive", clv > 0), ("negative", clv < 0), ("zero", clv == 0), ("gt_5", clv > 0.05), ("gt_10", clv > 0.10)):
        aggs.append(F.count_if(test).alias(f"n_{name}"))
    out = bets.groupBy(*keys).agg(
        *aggs,
        F.max(F.struct("clv", (-F.unix_date("quoted_on")).alias("d"), "quoted_on")).getField("quoted_on").alias("best_date"),
        F.min(F.struct("clv", F.unix_date("quoted_on").alias("d"), "quoted_on")).getField("quoted_on").alias("worst_date"),
    )
    return out.withColumn("positive_pct", F.col("n_positive") / F.col("total_bets") * 100)


def clv_by_month(bets: DataFrame) -> DataFrame:
    return bets.groupBy(F.date_format("quoted_on", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.avg("clv").alias("avg_clv"))


def clv_trend(bets: DataFrame, keys: list[str], order: list[str], unit: str = "month") -> DataFrame:
    """First 40 % of bets against the last 40 %, and the mean of the last few, per key."""
    counts = bets.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("clv").alias("overall"))
    out = with_row_index(bets, keys, order, "_i", unit).join(counts, keys)
    part = F.floor(F.col("n") * F.lit(0.4))
    few = F.greatest(F.lit(3), F.least(F.lit(10), F.floor(F.col("n") / 3)))
    out = out.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("overall").alias("overall"),
        F.avg(F.when(F.col("_i") < part, F.col("clv"))).alias("first_avg"),
        F.avg(F.when(F.col("_i") >= F.col("n") - part, F.col("clv"))).alias("last_avg"),
        F.avg(F.when(F.col("_i") >= F.col("n") - few, F.col("clv"))).alias("recent_avg"),
    )
    limit = 0.2 * F.greatest(F.abs("first_avg"), F.abs("last_avg"), F.lit(1e-6))
    shift = F.col("last_avg") - F.col("first_avg")
    direction = F.when(F.col("n") < 5, "Stable").when(shift > limit, "Improving").when(shift < -limit, "Declining").otherwise("Stable")
    versus = F.when(F.col("overall") != 0, (F.col("recent_avg") - F.col("overall")) / F.abs("overall") * 100).otherwise(0.0)
    return out.select(*keys, "n", "first_avg", "last_avg", "recent_avg", versus.alias("recent_vs_overall"), direction.alias("direction"))
