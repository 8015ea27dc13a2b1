"""Rolling inputs of the goals markets (over/under, both teams to score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.form import ORDER, rolling, team_game_log, to_match_rows
from touchline.operators.windows import Expanding, Feature, Trailing, with_asof

MIN_MATCHES = 2
WINDOWS = (5, 10, 20)


def market_rolling(
    log: DataFrame, metrics: dict[str, str], windows: tuple[int, ...] = WINDOWS, min_count: int = MIN_MATCHES, unit: str = "year"
) -> DataFrame:
    """Windowed and all-time means per team; a window needs `min_count` earlier games."""
    feats: dict[str, Feature] = {
        f"rolling_{m}_{w}": Trailing(F.expr(e), w, "avg", min_count) for m, e in metrics.items() for w in windows
    }
    feats |= {f"cumavg_{m}": Expanding(F.expr(e)) for m, e in metrics.items()}
    return with_asof(log, ["team"], ORDER, feats, unit)


def over_under_diffs(matches: DataFrame, windows: tuple[int, ...] = WINDOWS, unit: str = "year") -> DataFrame:
    """Attack minus opposing defence and the expected total, per match and window."""
    metrics = {"goals_scored": "scored", "goals_conceded": "conceded", "total_goals": "scored + conceded"}
    log = rolling(team_game_log(matches), metrics, windows, ["team"], MIN_MATCHES, "{metric}_{w}", unit)
    sides = to_match_rows(log, [f"{m}_{w}" for m in metrics for w in windows])
    cols = []
    for w in windows:
        cols += [
            (F.col(f"h_goals_scored_{w}") - F.col(f"a_goals_conceded_{w}")).alias(f"diff_att_def_{w}"),
            (F.col(f"a_goals_scored_{w}") - F.col(f"h_goals_conceded_{w}")).alias(f"diff_def_att_{w}"),
            ((F.col(f"h_total_goals_{w}") + F.col(f"a_total_goals_{w}")) / 2).alias(f"expected_total_goals_{w}"),
        ]
    return sides.select("*", *cols)
