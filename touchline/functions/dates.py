"""Date parsing and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order, each with the shape it must have.
DATE_FORMATS = [
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("dd/MM/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("dd-MM-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("dd/MM/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
]


def _lenient(fmt: str) -> str:
    return fmt if fmt == "yyyyMMdd" else fmt.replace("MM", "M").replace("dd", "d").replace("HH", "H").replace("mm", "m").replace("ss", "s")


def parse_date_flexible(text: Column, formats: list[tuple[str, str]] | None = None) -> Column:
    """First layout that fits gives the date; null when none does."""
    t = F.trim(text)
    tries = [
        F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(_lenient(fmt))))) for fmt, shape in formats or DATE_FORMATS
    ]
    return F.coalesce(*tries)


def parse_match_date(text: Column) -> Column:
    """Day-first dates when written with slashes, ISO dates otherwise."""
    return parse_date_flexible(text, [DATE_FORMATS[2], DATE_FORMATS[6], DATE_FORMATS[0], DATE_FORMATS[5]])


def season_start_year(date: Column) -> Column:
    """Seasons start in August: earlier months belong to the season of the year before."""
    return F.year(date) - (F.month(date) < 8).cast("int")


def week_of_season(date: Column) -> Column:
    """Weeks since the first of August, starting at 1."""
    start = F.make_date(season_start_year(date), F.lit(8), F.lit(1))
    return (F.floor(F.datediff(date, start) / 7) + 1).cast("int")


def date_parts(date: Column) -> dict[str, Column]:
    """Year, month, day of week (0 is Monday) and day of year."""
    return {"year": F.year(date), "month": F.month(date), "day_of_week": F.weekday(date), "day_of_year": F.dayofyear(date)}


def is_midweek(date: Column) -> Column:
    """1 from Tuesday to Thursday."""
    return F.weekday(date).isin(1, 2, 3).cast("int")
