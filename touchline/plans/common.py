"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6, off_tie: bool = False) -> DataFrame:
    """Keep `keep` as they are and round `values`, so float sums compare across engines."""
    nums = [(c, F.col(c).cast("double")) for c in values]
    return df.select(*keep, *[F.round(_off_tie(v) if off_tie else v, digits).alias(c) for c, v in nums])


def _off_tie(v: Column) -> Column:
    """Move a value a little away from zero, so exact halves round the same way in both engines."""
    return v + F.signum(v) * 1e-10


def rsql(values: dict[str, str], digits: int = 6, off_tie: bool = False) -> str:
    """SQL select items that round each expression the way `rounded` does."""
    if off_tie:
        values = {n: f"CAST({e} AS DOUBLE) + sign(CAST({e} AS DOUBLE)) * 1e-10" for n, e in values.items()}
    return ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) AS {n}" for n, e in values.items())
