"""Scalar parsing of names, money, positions, booleans and competitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position codes and the words that also select a group.
POSITION_CODES: dict[str, tuple[list[str], str, list[str]]] = {
    "GK": (["GK"], "GOAL", ["TW", "T"]),
    "DEF": (["DEF", "CB", "LB", "RB", "LWB", "RWB"], "DEF", ["AB", "IV", "LV", "RV"]),
    "MID": (["MID", "CM", "CDM", "CAM", "LM", "RM", "DM"], "MID", ["MF", "ZM", "OM"]),
    "FWD": (["FWD", "ST", "CF", "LW", "RW", "SS", "LF", "RF"], "FOR", ["ANG", "MS", "HS", "ST"]),
}

# Competition name fragment -> importance; the first fragment found counts.
COMPETITION_IMPORTANCE: dict[str, float] = {
    "world cup": 2.5,
    "fifa world cup": 2.5,
    "wc": 2.5,
    "euro": 2.0,
    "european championship": 2.0,
    "copa america": 2.0,
    "africa cup": 2.0,
    "afcon": 2.0,
    "asian cup": 2.0,
    "gold cup": 2.0,
    "nations league": 1.5,
    "uefa nations league": 1.5,
    "world cup qualifying": 1.5,
    "world cup qualification": 1.5,
    "wc qual": 1.5,
    "wcq": 1.5,
    "euro qualifying": 1.2,
    "euro qualification": 1.2,
    "uefa champions league": 1.3,
    "champions league": 1.3,
    "uefa europa league": 1.2,
    "europa league": 1.2,
    "premier league": 1.0,
    "la liga": 1.0,
    "serie a": 1.0,
    "bundesliga": 1.0,
    "ligue 1": 1.0,
    "eredivisie": 1.0,
    "primeira liga": 1.0,
    "friendly": 0.6,
    "international friendly": 0.6,
    "club friendly": 0.4,
}
KNOCKOUT_WORDS = ["final", "semi", "quarter", "round of"]

# Club words dropped at the end and at the start of a name.
CLUB_ENDINGS = "fc|cf|afc|utd|united|city|town|rangers|athletic|ac|acm|as|ssc|ss|fk|bk|if|il|jk"
CLUB_BEGINNINGS = "fc|cf|afc|ac|as|ssc|ss|fk|bk|if|il|jk"


def position_group(position: Column) -> Column:
    """Free-text position to GK, DEF, MID or FWD; unknown text counts as MID."""
    p = F.upper(F.trim(position))
    out = F.lit("MID")
    for group in reversed(POSITION_CODES):
        codes, word, more = POSITION_CODES[group]
        out = F.when(p.isin(codes + more) | p.contains(word), group).otherwise(out)
    return out


def parse_boolean(value: Column) -> Column:
    """true, yes, y and 1 in any case are true; everything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "y", "1", "1.0"), F.lit(False))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _scaled(text: Column, units: list[tuple[str, float]]) -> Column:
    """Number with an optional unit at its end, in millions; 0 when it is not a number."""

    def number(t: Column) -> Column:
        t = F.trim(t)
        return F.when(t.rlike(_NUMBER), t.try_cast("double"))

    out = number(text)
    for unit, factor in reversed(units):
        head = F.substring(text, F.lit(1), F.length(text) - len(unit))
        out = F.when(text.endswith(unit), number(head) * factor).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def _plain(text: Column) -> Column:
    return F.trim(F.translate(F.trim(text), "€,", ""))


def parse_market_value(text: Column) -> Column:
    """Market value text such as 1.2bn, 75m, 500k or 300Tsd. in millions of euros."""
    return _scaled(_plain(text), [("bn", 1000.0), ("m", 1.0), ("k", 0.001), ("Tsd.", 0.001)])


def parse_transfer_fee(text: Column) -> Column:
    """Transfer fee text in millions of euros; free moves and loans are 0 unless a loan fee is named."""
    lowered = F.lower(F.trim(text))
    free = lowered.contains("free") | lowered.contains("end of loan") | lowered.contains("loan fee")
    fee = F.regexp_replace(F.regexp_extract(F.trim(text), r"€?(\d+[.,]?\d*)\s*[mM]", 1), ",", ".").try_cast("double")
    paid = _scaled(_plain(text), [("bn", 1000.0), ("m", 1.0), ("k", 0.001)])
    return F.when(free, F.coalesce(fee, F.lit(0.0))).otherwise(paid)


def team_key(name: Column) -> Column:
    """Name reduced for matching: lower case, club words at both ends dropped, letters and digits only."""
    n = F.lower(F.trim(name))
    n = F.regexp_replace(n, rf"\s+({CLUB_ENDINGS})$", "")
    n = F.regexp_replace(n, rf"^({CLUB_BEGINNINGS})\s+", "")
    return F.regexp_replace(n, "[^a-z0-9]", "")


def competition_importance(league: Column, round_name: Column | None = None, longest: bool = False) -> Column:
    """Importance of a competition; knock-out rounds of important ones count 20 % more.

    The first fragment in declaration order wins, so "world cup" also covers its qualifiers;
    `longest=True` tries longer fragments first.
    """
    name = F.lower(F.trim(league))
    order = list(COMPETITION_IMPORTANCE.items())
    if longest:
        order.sort(key=lambda kv: -len(kv[0]))
    weight = F.lit(1.0)
    for fragment, w in reversed(order):
        weight = F.when(name.contains(fragment), w).otherwise(weight)
    if round_name is None:
        return weight
    knockout = F.lit(False)
    for word in KNOCKOUT_WORDS:
        knockout = knockout | F.lower(round_name).contains(word)
    return F.when((weight >= 1.5) & F.coalesce(knockout, F.lit(False)), weight * 1.2).otherwise(weight)


def is_placeholder_team(name: Column) -> Column:
    """Names such as W101 or L5 that stand for the winner or loser of another match."""
    return F.coalesce(name.rlike(r"^[WRQPL][0-9]+$"), F.lit(False))


def first_token(name: Column) -> Column:
    return F.split(F.lower(F.trim(name)), " ").getItem(0)


def same_first_token(a: Column, b: Column) -> Column:
    """Derby flag: both names begin with the same word."""
    return (first_token(a) == first_token(b)).cast("int")
