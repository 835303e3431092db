"""Normalizing and typing of landed schedules, team statistics and player tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe import schemas
from pitchframe.functions.numeric import BLANK_TEXTS, integer_of, number_of
from pitchframe.functions.text import canonical_team, parse_score, stripped
from pitchframe.plans.scratch import written
from pitchframe.plans.skew import lookup

NUMERIC_SHARE = 0.8
REPORT_ID_PATTERN = r"/matches/([^/]+)/"


def normalize_schedule(df: DataFrame, *, skip_brackets: bool = False) -> DataFrame:
    """``game_id`` or ``match_id`` as ``fixture_id``; goals parsed from ``score``."""
    if "game_id" in df.columns:
        df = df.withColumnRenamed("game_id", "fixture_id")
    elif "fixture_id" not in df.columns and "match_id" in df.columns:
        df = df.withColumnRenamed("match_id", "fixture_id")
    if "score" in df.columns:
        home, away = parse_score(F.col("score").cast("string"), skip_brackets=skip_brackets)
        df = df.withColumns({"home_goals": home, "away_goals": away})
    return df


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_profile(df: DataFrame) -> DataFrame:
    """Per text column: filled entries, numbers among them, whether all are integral.

    One aggregation over all columns; the result has one row per text column
    (none for an empty table).
    """
    names = _text_columns(df)
    if not names:
        return schemas.empty(
            df.sparkSession,
            schemas.table_schema("column string, non_blank bigint, numeric bigint, integral boolean"),
        )
    texts = F.array(
        *[F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("text")) for name in names]
    )
    # long form: one short expression for all columns, combined before the shuffle; each
    # text is stripped and parsed once, and what follows refers to that
    text, number = F.col("text"), F.col("number")
    filled = text.isNotNull() & ~text.isin(*BLANK_TEXTS)
    # a whole number beyond 64 bits is not an integer of any column
    whole = F.when(number.isNotNull(), integer_of(text, number).isNotNull())
    return (
        df.select(F.inline(texts))
        .select("column", stripped(F.col("text")).alias("text"))
        .select("column", "text", number_of(text).alias("number"))
        .select("column", filled.alias("filled"), "number", whole.alias("whole"))
        .groupBy("column")
        .agg(
            F.count_if("filled").alias("non_blank"),
            F.count("number").alias("numeric"),
            F.coalesce(F.bool_and("whole"), F.lit(True)).alias("integral"),
        )
    )


def infer_numeric(df: DataFrame, share: float = NUMERIC_SHARE) -> dict[str, str]:
    """``{column: bigint or double}`` for the text columns that hold numbers.

    The one action of the typing step: it brings one row per column to the driver.
    """
    profile = numeric_profile(df).where("non_blank > 0").collect()
    return {
        r["column"]: "bigint" if r["integral"] else "double"
        for r in profile
        if r["numeric"] / r["non_blank"] >= share
    }


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to the given numeric types; anything else in them becomes null."""
    if not types:
        return df
    # parsed once into columns of their own, which the casts refer to
    mark = "__parsed_"
    texts = {f"{mark}text_{c}": stripped(F.col(f"`{c}`")) for c in types}
    numbers = {f"{mark}number_{c}": number_of(F.col(f"`{mark}text_{c}`")) for c in types}
    casts = {}
    for c, t in types.items():
        text, number = F.col(f"`{mark}text_{c}`"), F.col(f"`{mark}number_{c}`")
        casts[c] = integer_of(text, number) if t == "bigint" else number.cast(t)
    return df.withColumns(texts).withColumns(numbers).withColumns(casts).select(*[F.col(f"`{c}`") for c in df.columns])


def sanitize_match_stats(
    df: DataFrame, types: dict[str, str] | None = None, share: float = NUMERIC_SHARE
) -> DataFrame:
    """Type number-like text columns, by the given types or by their content."""
    return apply_types(df, infer_numeric(df, share) if types is None else types)


def match_stats_for_fixture(
    stats: DataFrame, fixture_id: str, types: dict[str, str] | None = None
) -> DataFrame:
    """Statistics rows of one fixture, found by report link, else by game id."""
    wanted = F.lit(str(fixture_id))
    if "match_report" in stats.columns:
        stats = stats.where(F.coalesce(F.col("match_report").contains(wanted), F.lit(False)))
    else:
        for key in ("game", "game_id"):
            if key in stats.columns:
                stats = stats.where(F.col(key).cast("string") == wanted)
                break
    # the id is added after typing: it stays text even if it looks like a number
    typed = sanitize_match_stats(stats.drop("fixture_id"), types)
    return typed.select(wanted.alias("fixture_id"), *typed.columns)


def resolve_fixture_key(
    stats: DataFrame, fixtures: DataFrame, pattern: str = REPORT_ID_PATTERN
) -> DataFrame:
    """Statistics rows of all fixtures at once, each with its ``fixture_id``.

    The id is cut out of the report link, so fixtures join by equality. A row
    without a link, or with one of no fixture, is matched by (date, team) under
    canonical names. Rows matching no fixture are left out.
    """
    at = lambda date, team: F.concat(
        F.lit("at "), F.col(date).cast("string"), F.lit("|"), canonical_team(F.col(team))
    )
    by_id = lambda c: F.concat(F.lit("id "), c)
    link = F.nullif(F.regexp_extract("match_report", pattern, 1), F.lit(""))
    # both ways of finding a fixture in one table, so both inputs are read once
    ways = F.array(by_id(F.col("fixture_id")), at("date", "home_team"), at("date", "away_team"))
    known = (
        fixtures.select("fixture_id", F.explode(ways).alias("__key"))
        .where(F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.min("fixture_id").alias("fixture_id"))
    )
    names = [c for c in stats.columns if c != "fixture_id"]
    # a row with a link is looked for by that alone, so that one join serves nearly all rows
    keyed = stats.drop("fixture_id").withColumn("__key", F.coalesce(by_id(link), at("date", "team")))
    known = written(known, "fixture-keys")
    first = written(lookup(keyed, known, ["__key"]).select("fixture_id", *names), "linked")
    found = first.where(F.col("fixture_id").isNotNull())
    # what is left are links to no fixture, and rows that have no second key
    missing = F.when(link.isNotNull(), at("date", "team"))
    left = first.where(F.col("fixture_id").isNull()).select(*names, missing.alias("__key")).where(F.col("__key").isNotNull())
    if left.isEmpty():
        return found
    return found.unionByName(lookup(left, known, ["__key"], "inner").select("fixture_id", *names))


def player_minutes(players: DataFrame, fixture_id: str) -> DataFrame:
    """Player rows of one fixture, unchanged."""
    return players.where(F.col("fixture_id").cast("string") == str(fixture_id))


def conform_player_logs(players: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Player summaries as player logs: standard names, an id, the date of the fixture.

    A player without a name has no id.
    """
    for old, new in (("player", "player_name"), ("minutes", "minutes_played")):
        if new not in players.columns and old in players.columns:
            players = players.withColumnRenamed(old, new)
    if "player_id" not in players.columns:
        players = players.withColumn("player_id", F.when(F.col("player_name").isNotNull(), F.concat_ws("|", "player_name", "team")))
    players = schemas.with_nulls_for_missing(players, {"position": "string"})
    dates = fixtures.groupBy("fixture_id").agg(F.min("date").alias("date"))
    joined = lookup(players.drop("date"), dates, ["fixture_id"])
    return joined.select(*[F.col(f.name).cast(f.dataType) for f in schemas.PLAYER_LOGS.fields])


def elo_snapshot(elo: DataFrame, date: str | None = None) -> DataFrame:
    """Latest rating per team, on or before ``date`` if given.

    Ratings of one date are ordered by value, so the result does not depend on
    the order of the rows.
    """
    if date is not None:
        elo = elo.where(F.col("date") <= F.lit(date).cast("timestamp_ntz"))
    latest = F.max(F.struct("date", "elo"))
    return elo.groupBy("team").agg(latest.alias("r")).select("team", "r.date", "r.elo")


def elo_history(elo: DataFrame, team: str | None = None) -> DataFrame:
    """Ratings of one team (all teams for ``None``) in order of date."""
    if team is not None:
        elo = elo.where(F.col("team") == team)
    return elo.select("team", "date", "elo").orderBy("team", "date")


def player_season_minutes(logs: DataFrame, keys: Sequence[str] = ("season", "player_id")) -> DataFrame:
    """Minutes and appearances per player and season."""
    return logs.groupBy(*keys).agg(
        F.coalesce(F.sum("minutes_played"), F.lit(0.0)).alias("minutes_played"),
        F.count_if(F.col("minutes_played") > 0).alias("appearances"),
        F.count("*").alias("fixtures"),
    )
