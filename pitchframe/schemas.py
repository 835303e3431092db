"""Fixed schemas of the tables that travel between the stages.

Dates are ``timestamp_ntz``: kick-off times carry no zone of their own, so a
session time zone must not shift them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def table_schema(columns: str) -> T.StructType:
    """Schema of a ``name type, ...`` list, without needing a session."""
    fields = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


SCHEDULE = table_schema(
    "game_id string, date string, home_team string, score string, away_team string, "
    "season string, league string"
)
FIXTURES = table_schema(
    "fixture_id string, season string, league string, date timestamp_ntz, home_team string, "
    "away_team string, home_goals double, away_goals double, home_xg double, away_xg double"
)
MATCH_STATS = table_schema(
    "fixture_id string, team string, opponent string, xg double, shots bigint, sot bigint, "
    "match_report string"
)
ELO = table_schema("team string, date timestamp_ntz, elo double")
PLAYER_LOGS = table_schema(
    "fixture_id string, date timestamp_ntz, team string, player_id string, player_name string, "
    "position string, minutes_played double"
)
ABSENCES = table_schema(
    "fixture_id string, date timestamp_ntz, team string, player_id string, player_name string, "
    "position_group string, absence_type string, starter_minute_share double"
)

SIDE_STATS = ("xg", "shots", "sot")
REQUIRED_FIXTURE_COLUMNS = ("fixture_id", "home_team", "away_team", "date")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed table without rows, for a stage whose input is absent."""
    return spark.createDataFrame([], schema)


def with_nulls_for_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each absent column of ``{name: type}`` as typed null."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column (a missing measurement is null)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    fixed: dict[str, Column] = {c: F.when(~F.isnan(c), F.col(c)) for c in floats}
    return df.withColumns(fixed) if fixed else df
