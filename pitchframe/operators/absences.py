"""Absences of regular starters from player logs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe import schemas
from pitchframe.functions import numeric
from pitchframe.functions.text import position_group
from pitchframe.operators.clean import with_dates
from pitchframe.plans.ordered import OrderedGroups, ordered_groups

STARTER_SHARE = 0.45
MINUTES_WINDOW = 5
MATCH_MINUTES = 90.0


def _per_player(logs: DataFrame) -> OrderedGroups:
    known = with_dates(logs).where(F.col("player_id").isNotNull())
    return ordered_groups(known, ["player_id"], ["date", "fixture_id"])


def _add_share(groups: OrderedGroups, window: int) -> OrderedGroups:
    def share(w):
        return {
            "starter_minute_share": F.coalesce(F.avg("minutes_played").over(w), F.lit(0.0))
            / F.lit(MATCH_MINUTES)
        }

    return groups.rolling(window, share, reads=["minutes_played"])


def _add_run(groups: OrderedGroups) -> OrderedGroups:
    # A run ends at the last played row: its length is the number of missed rows
    # so far minus that number as of the last played row.
    missed = F.coalesce(F.col("minutes_played") == 0, F.lit(True))
    groups = groups.running({"__missed": ("sum", missed.cast("bigint"))}, inclusive=True)
    groups = groups.running({"__before": ("max", F.when(~missed, F.col("__missed")))}, inclusive=True)
    run = F.when(missed, F.col("__missed") - F.coalesce("__before", F.lit(0))).otherwise(F.lit(0))
    return groups.with_frame(
        groups.frame.withColumns({"consecutive_missed": run, "is_missed": missed}).drop("__missed", "__before")
    )


def starter_minute_share(logs: DataFrame, window: int = MINUTES_WINDOW) -> DataFrame:
    """Share of minutes over a player's previous ``window`` rows (0 if there are none)."""
    return _add_share(_per_player(logs), window).result()


def consecutive_missed(logs: DataFrame) -> DataFrame:
    """Length of the run of missed matches that ends at each row."""
    return _add_run(_per_player(logs)).result()


def absence_runs(
    logs: DataFrame,
    *,
    threshold: float = STARTER_SHARE,
    window: int = MINUTES_WINDOW,
    injury_run: int = numeric.INJURY_RUN,
) -> DataFrame:
    """Absences of regular starters with the length of the run so far."""
    logs = schemas.with_nulls_for_missing(logs, {"position": "string"})
    rows = _add_run(_add_share(_per_player(logs), window)).result()
    return (
        rows.where((F.col("starter_minute_share") >= threshold) & F.col("is_missed"))
        .withColumn("position_group", position_group(F.col("position")))
        .withColumn("absence_type", numeric.absence_type(F.col("consecutive_missed"), injury_run))
        .select(*schemas.ABSENCES.fieldNames(), "consecutive_missed")
    )


def player_absences(logs: DataFrame, **parameters) -> DataFrame:
    """Classified absences, one row per (player, fixture)."""
    return absence_runs(logs, **parameters).select(*schemas.ABSENCES.fieldNames())
