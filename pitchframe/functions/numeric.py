"""Column functions over numbers and number-like text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchframe.functions.text import stripped

# The shape of a decimal number; a text of another shape isn't cast, as a failing cast costs many times a match.
_DECIMAL = r"\A[+-]?[0-9.]+([eE][+-]?[0-9]+)?\z"

# Texts that count as a missing entry.
BLANK_TEXTS = ("", "nan", "None", "<NA>")

# League mean of goals per side and home advantage of a cold start.
MEAN_GOALS = 1.35
COLD_START_ADVANTAGE = 1.25

# An absence of this many matches in a row counts as an injury.
INJURY_RUN = 2


def is_blank(c: Column) -> Column:
    return F.coalesce(stripped(c).isin(*BLANK_TEXTS), F.lit(True))


def to_number(c: Column) -> Column:
    """Double value of a decimal number, null for any other text."""
    return number_of(stripped(c))


def number_of(text: Column) -> Column:
    """Double value of a stripped text that is a decimal number, else null.

    The cast accepts more than that: names and suffixes (``Infinity``, ``1.5f``), hexadecimal forms, and
    control characters around a number. Most other texts are told by their ends alone.
    """
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    plain = first.between("+", "9") & last.between(".", "9") & text.rlike(_DECIMAL)
    return F.when(plain, text.try_cast("double"))


def integer_of(text: Column, number: Column) -> Column:
    """Bigint value of a stripped text with the value ``number``, digit by digit, if it is whole and fits."""
    exact = F.when(number.isNotNull(), text.try_cast("bigint"))
    return F.coalesce(exact, F.when(number % 1 == 0, number.try_cast("bigint")))


def to_integer(c: Column) -> Column:
    """Bigint value of a decimal number that is whole and fits, digit by digit; null for any other text."""
    return integer_of(stripped(c), to_number(c))


def expected_goals(
    home_attack: Column,
    home_defense: Column,
    away_attack: Column,
    away_defense: Column,
    advantage: Column,
    *,
    mean_goals: float = MEAN_GOALS,
) -> tuple[Column, Column]:
    """Expected home and away goals, to three decimals (half to even).

    An advantage of zero (away goals alone so far) leaves the away side infinite, or NaN if one of its
    strengths is zero too.
    """
    lift = F.sqrt(advantage)
    home = F.lit(mean_goals) * home_attack * away_defense * lift
    away = F.lit(mean_goals) * away_attack * home_defense
    away = F.when(lift == 0, away * F.lit(float("inf"))).otherwise(away / F.nullif(lift, F.lit(0.0)))
    return F.bround(home, 3), F.bround(away, 3)


def absence_type(run: Column, injury_run: int = INJURY_RUN) -> Column:
    return F.when(run >= injury_run, F.lit("injury")).otherwise(F.lit("rotation_suspension"))
