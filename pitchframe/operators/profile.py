"""Validation, missing values, summaries and counts of stage tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.clean import chronological
from pitchframe.plans.ordered import ordered_groups
from pitchframe.plans.scratch import written
from pitchframe.schemas import REQUIRED_FIXTURE_COLUMNS


def validate_fixtures(
    df: DataFrame, required: Sequence[str] = REQUIRED_FIXTURE_COLUMNS
) -> DataFrame:
    """One row: number of rows, names of absent required columns, distinct ids.

    Every later stage takes ``fixture_id`` as unique; ``fixture_ids`` below
    ``rows`` shows a violation.
    """
    missing = ", ".join(c for c in required if c not in df.columns)
    if "fixture_id" in df.columns:
        copies = df.groupBy("fixture_id").agg(F.count("*").alias("copies"))
        totals = copies.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count("fixture_id").alias("fixture_ids")
        )
    else:
        totals = df.agg(F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("fixture_ids"))
    return totals.withColumn("missing_columns", F.lit(missing))


def missing_profile(df: DataFrame, flags: Sequence[str] = ("is_xg_missing",)) -> DataFrame:
    """Columns with missing values: their number and rate, and how often each flag is set."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    flagged = [f for f in flags if f in df.columns]
    counts += [F.count_if(F.col(f)).alias(f"f{i}") for i, f in enumerate(flagged)]
    names = [(c, f"m{i}") for i, c in enumerate(df.columns)]
    names += [(f"{f} = true", f"f{i}") for i, f in enumerate(flagged)]
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).alias("rows")) for n, c in names])
    return (
        df.agg(F.count("*").alias("total"), *counts)
        .select("total", F.inline(rows))
        .where(F.col("rows") > 0)
        .select("column", "rows", (F.col("rows") / F.col("total")).alias("rate"))
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each column.

    Quartiles interpolate linearly between neighbouring ranks. Ranks come from
    running counts over the distinct values, so no task holds a whole column.
    """
    stacked = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    ).where(F.col("value").isNotNull())
    # the input is read once; everything else follows from its distinct values
    distinct = written(stacked.groupBy("column", "value").agg(F.count("*").alias("__n")), "values")
    totals = distinct.groupBy("column").agg(
        F.sum("__n").alias("count"),
        (F.sum(F.col("value") * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    ranked = (
        ordered_groups(distinct, ["column"], ["value"])
        .running({"__upto": ("sum", F.col("__n"))}, inclusive=True)
        .result()
        # one row per described column
        .join(F.broadcast(totals), "column")
    )
    count = F.col("count")
    squares = F.sum(F.col("__n") * F.pow(F.col("value") - F.col("mean"), 2))
    std = F.sqrt(squares / F.nullif(F.first("count") - 1, F.lit(0)))
    quartiles, ranks = {}, []
    for name, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        place = (count - 1) * F.lit(share)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
            ranks.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{end}"))
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        # two equal neighbours need no interpolation, which would make NaN of infinite ones
        quartiles[name] = F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))
    return (
        ranked.groupBy("column", "count", "mean", "min", "max")
        .agg(std.alias("std"), *ranks)
        .withColumns(quartiles)
        .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column, most frequent first."""
    stacked = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    )
    counted = stacked.groupBy("column", "value").agg(F.count("*").alias("rows"))
    return counted.orderBy("column", F.col("rows").desc(), "value")


def absence_distribution(absences: DataFrame) -> DataFrame:
    return value_counts(absences, ["absence_type", "position_group"])


def absence_by_season(absences: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Absences per season and type; the season is that of the fixture."""
    # counted per fixture first, so a fixture with very many rows is one row in the join
    counted = absences.groupBy("fixture_id", "absence_type").agg(F.count("*").alias("__n"))
    seasons = fixtures.select("fixture_id", "season")
    joined = counted.join(seasons, "fixture_id", "left")
    return joined.groupBy("season", "absence_type").agg(F.sum("__n").alias("absences"))


def sample(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` fixtures in chronological order."""
    keys = [c for c in ("date", "fixture_id") if c not in columns]
    return chronological(df.select(*columns, *keys)).limit(n).select(*columns)
