"""Cleaning stage: names, dates, team statistics, differentials."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe import schemas
from pitchframe.functions.text import TEAM_ALIASES, canonical_team, stripped
from pitchframe.plans.skew import lookup

DIFFERENTIALS = ("goals", "xg", "shots", "sot")
_ROLES = ("home", "away")


def standardize_teams(
    df: DataFrame,
    columns: Sequence[str] = ("home_team", "away_team"),
    aliases: Mapping[str, str] | DataFrame = TEAM_ALIASES,
) -> DataFrame:
    """Canonical names in each listed column that exists.

    ``aliases`` is a small mapping, or a table ``(alias, canonical)`` of any size.
    """
    present = [c for c in columns if c in df.columns]
    if not isinstance(aliases, DataFrame):
        return df.withColumns({c: canonical_team(F.col(c), aliases) for c in present})
    names = df.columns
    table = aliases.groupBy("alias").agg(F.min("canonical").alias("__canonical"))
    for c in present:
        named = lookup(df.withColumn("alias", stripped(F.col(c))), table, ["alias"])
        df = named.withColumn(c, F.coalesce("__canonical", "alias")).drop("alias", "__canonical")
    return df.select(*names)


def xg_missing() -> Column:
    return F.col("home_xg").isNull() | F.col("away_xg").isNull()


def with_xg_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_xg_missing", xg_missing())


def base_differentials(df: DataFrame) -> DataFrame:
    """Home minus away per measure; null if a side is null or its column absent."""

    def diff(measure: str) -> Column:
        home, away = (f"{role}_{measure}" for role in _ROLES)
        if home in df.columns and away in df.columns:
            return F.col(home).cast("double") - F.col(away).cast("double")
        return F.lit(None).cast("double")

    return df.withColumns({f"{m}_diff": diff(m) for m in DIFFERENTIALS})


def with_side_columns(df: DataFrame) -> DataFrame:
    """Add absent home/away statistics as null."""
    return schemas.with_nulls_for_missing(
        df, {f"{role}_{m}": "double" for m in schemas.SIDE_STATS for role in _ROLES}
    )


def _first_known(measure: str, order_by: Sequence[str]) -> Column:
    position = F.struct(*order_by, measure)
    return F.min_by(measure, F.when(F.col(measure).isNotNull(), position)).cast("double")


def merge_match_stats(
    fixtures: DataFrame,
    stats: DataFrame,
    *,
    aliases: Mapping[str, str] | DataFrame = TEAM_ALIASES,
    order_by: Sequence[str] = ("match_report",),
) -> DataFrame:
    """Each fixture with xg, shots and sot of its home and its away team.

    The statistics are first reduced to one row per (fixture, team), taking the
    first known value in ``order_by`` order, so repeated rows collapse before
    the shuffle. A value the fixture already has wins over the statistics.
    """
    fixtures = with_side_columns(standardize_teams(fixtures, aliases=aliases))
    stats = standardize_teams(stats, ("team", "opponent"), aliases)
    stats = schemas.with_nulls_for_missing(
        stats, {**{m: "double" for m in schemas.SIDE_STATS}, **{c: "string" for c in order_by}}
    )
    per_team = (
        stats.where(F.col("fixture_id").isNotNull() & F.col("team").isNotNull())
        .groupBy("fixture_id", "team")
        .agg(*[_first_known(m, order_by).alias(m) for m in schemas.SIDE_STATS])
    )
    merged = fixtures
    for role in _ROLES:
        side = per_team.select(
            "fixture_id",
            F.col("team").alias(f"{role}_team"),
            *[F.col(m).alias(f"__{role}_{m}") for m in schemas.SIDE_STATS],
        )
        merged = merged.join(side, ["fixture_id", f"{role}_team"], "left")
    filled = {
        f"{role}_{m}": F.coalesce(F.col(f"{role}_{m}").cast("double"), F.col(f"__{role}_{m}"))
        for m in schemas.SIDE_STATS
        for role in _ROLES
    }
    return with_xg_flag(merged.withColumns(filled).select(*fixtures.columns))


def with_dates(df: DataFrame, *, strict: bool = True) -> DataFrame:
    """``date`` as a timestamp; unreadable text is an error, or null if not strict."""
    if isinstance(df.schema["date"].dataType, T.TimestampNTZType):
        return df
    cast = F.col("date").cast if strict else F.col("date").try_cast
    return df.withColumn("date", cast("timestamp_ntz"))


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("date").asc_nulls_last(), "fixture_id")


def clean_fixtures(
    fixtures: DataFrame,
    stats: DataFrame | None = None,
    *,
    aliases: Mapping[str, str] | DataFrame = TEAM_ALIASES,
    ordered: bool = False,
) -> DataFrame:
    """The cleaning stage as one plan: one row per fixture with flags and differentials.

    No later stage relies on row order, so the global sort is done on request only.
    """
    df = standardize_teams(fixtures, aliases=aliases)
    if "date" in df.columns:
        df = with_dates(df)
    if stats is None:
        df = with_xg_flag(with_side_columns(df))
    else:
        df = merge_match_stats(df, stats, aliases=aliases)
    df = base_differentials(df)
    return chronological(df) if ordered else df
