"""Readers of landed tables and the writer of stage outputs.

A landed folder is partitioned by ``season`` (label ``2024-2025``), so a season
filter prunes directories before any file is opened.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe import schemas
from pitchframe.functions.text import plain_season_label
from pitchframe.operators import ingest


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Files at ``path`` (Parquet, ORC, JSON or CSV), read with a fixed schema if given.

    A NaN in a floating column is read as null: a missing measurement.
    """
    reader = spark.read.format(fmt).options(**options)
    return schemas.nan_to_null((reader.schema(schema) if schema else reader).load(path))


def scan_or_empty(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Like :func:`scan`; a typed table without rows when nothing has been landed."""
    try:
        return scan(spark, path, schema, fmt)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty(spark, schema)


def of_season(df: DataFrame, season: str | None = None, league: str | None = None) -> DataFrame:
    """Rows of one season (either label form) and league; no filter for ``None``."""
    if season is not None:
        df = df.where(F.col("season") == plain_season_label(season))
    if league is not None:
        df = df.where(F.col("league") == league)
    return df


def fixtures(landed: DataFrame, season: str | None = None, league: str | None = None) -> DataFrame:
    """Schedule of a season with normalized ids and goals."""
    return ingest.normalize_schedule(of_season(landed, season, league))


def match_stats(landed: DataFrame, season: str | None = None, league: str | None = None) -> DataFrame:
    """Team statistics of a season with number-like text columns typed."""
    return ingest.sanitize_match_stats(of_season(landed, season, league))


def write_table(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), fmt: str = "parquet", others: str = "replace"
) -> None:
    """Overwrite ``path``; with partition columns the rows are first clustered by them.

    ``others="keep"`` replaces only the partitions that ``df`` has rows of, so one season can be
    landed again beside the others; no rows then change nothing.

    The rebalance hint lets adaptive execution split a large season over many
    writers, so neither one task nor thousands of small files result.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if others not in ("replace", "keep") or (others == "keep" and not partition_by):
        raise ValueError(f"others is 'replace', or 'keep' with partition columns: {others}")
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic" if others == "keep" else "static").save(path)
