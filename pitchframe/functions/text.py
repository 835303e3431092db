"""Column functions over labels, scores, names and positions."""
from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Team name variants and the canonical name of each.
TEAM_ALIASES: dict[str, str] = {
    "Manchester Utd": "Manchester United",
    "Man United": "Manchester United",
    "Man Utd": "Manchester United",
    "Manchester City": "Manchester City",
    "Man City": "Manchester City",
    "Newcastle": "Newcastle United",
    "Newcastle Utd": "Newcastle United",
    "Nottingham": "Nottingham Forest",
    "Nott'm Forest": "Nottingham Forest",
    "Tottenham": "Tottenham Hotspur",
    "West Ham": "West Ham United",
    "Wolves": "Wolverhampton Wanderers",
    "Wolverhampton": "Wolverhampton Wanderers",
    "Leicester City": "Leicester City",
    "Leicester": "Leicester City",
    "Ipswich Town": "Ipswich Town",
    "Ipswich": "Ipswich Town",
    "Brighton": "Brighton & Hove Albion",
    "Brighton & Hove": "Brighton & Hove Albion",
    "West Brom": "West Bromwich Albion",
    "Sheffield Utd": "Sheffield United",
    "Luton Town": "Luton Town",
    "Luton": "Luton Town",
    "Leeds United": "Leeds United",
    "Leeds": "Leeds United",
}

# Position tag and its group.
POSITION_GROUPS: dict[str, str] = {
    "GK": "GK",
    "DF": "DEF",
    "CB": "DEF",
    "LB": "DEF",
    "RB": "DEF",
    "WB": "DEF",
    "MF": "MID",
    "DM": "MID",
    "CM": "MID",
    "AM": "MID",
    "FW": "FWD",
    "ST": "FWD",
    "LW": "FWD",
    "RW": "FWD",
}
DEFAULT_POSITION_GROUP = "MID"

SEASON_PATTERN = r"\A([0-9]{4})[/-]([0-9]{4})\z"
SCORE_PATTERN = r"([0-9]+)[^0-9]+([0-9]+)"
_BLANKS = " \t\r\n\f\x0b"


def stripped(c: Column) -> Column:
    """Without surrounding white space of any kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(_BLANKS))


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of ``key`` in a small literal mapping, else null."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def plain_season_label(season: str) -> str:
    """The label of a season given as text, for use in a filter; anything else is an error."""
    if not re.fullmatch(r"[0-9]{4}[/-][0-9]{4}", season):
        raise ValueError(f"season must be YYYY/YYYY or YYYY-YYYY: {season}")
    return season.replace("/", "-")


def season_label(c: Column, *, strict: bool = False) -> Column:
    """``2024/2025`` or ``2024-2025`` as ``2024-2025``; null, or an error if strict, otherwise."""
    fits = F.coalesce(c.rlike(SEASON_PATTERN), F.lit(False))
    label = F.regexp_replace(c, "/", "-")
    if strict:
        bad = F.raise_error(F.concat(F.lit("season must be YYYY/YYYY or YYYY-YYYY: "), F.coalesce(c, F.lit("null"))))
        return F.when(fits, label).otherwise(bad.cast("string"))
    return F.when(fits, label)


def parse_score(c: Column, *, skip_brackets: bool = False) -> tuple[Column, Column]:
    """Home and away goals: the first two digit runs with non-digits between them.

    With ``skip_brackets`` a leading bracketed number (a shoot-out result) is
    not taken for the home score.
    """
    text = F.regexp_replace(c, r"\A\s*\([^)]*\)", "") if skip_brackets else c

    def goals(group: int) -> Column:
        return F.nullif(F.regexp_extract(text, SCORE_PATTERN, group), F.lit("")).cast("double")

    return goals(1), goals(2)


def canonical_team(c: Column, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    """Canonical team name; an unknown name is only trimmed."""
    name = stripped(c)
    return F.coalesce(lookup(aliases, name), name) if aliases else name


def position_group(c: Column) -> Column:
    """GK, DEF, MID or FWD from the first of a comma-separated position list."""
    first = F.upper(stripped(F.split_part(c, F.lit(","), F.lit(1))))
    return F.coalesce(lookup(POSITION_GROUPS, first), F.lit(DEFAULT_POSITION_GROUP))
