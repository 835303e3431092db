"""Keys that hold too many rows for one task, and joins that spread their rows."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.plans.scratch import written

MAX_GROUP_ROWS = 1_000_000
MAX_GROUP_ROWS_CONF = "spark.pitchframe.maxGroupRows"
# Longest key list sent to every executor.
MAX_HOT_KEYS = 1_000_000


# Rows of one task of an explicit shuffle.
TASK_ROWS = 100_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that share ``rows`` rows: every core has one, none gets many more than ``TASK_ROWS``."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def max_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_GROUP_ROWS_CONF, str(MAX_GROUP_ROWS)))


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should get, at most ``MAX_HOT_KEYS`` of them.

    ``rows`` are theirs, ``all_rows`` those of the whole table.
    """

    keys: DataFrame | None
    rows: int
    null_rows: int
    all_rows: int = 0


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> HotKeys:
    """Count rows per key, combined before the shuffle, over the key columns alone."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    known = ~_any_null(keys)
    over = known & (F.col("__rows") > limit)
    totals = counts.agg(
        F.count_if(over).alias("keys"),
        F.coalesce(F.sum(F.when(over, F.col("__rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("__rows"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("all"),
    ).first()
    if not totals["keys"]:
        return HotKeys(None, 0, totals["nulls"], totals["all"])
    # a larger limit where needed: no more than rows / limit keys can exceed it
    limit = max(limit, math.ceil(totals["rows"] / MAX_HOT_KEYS))
    found = written(counts.where(known & (F.col("__rows") > limit)).select(*keys), "hot-keys")
    return HotKeys(F.broadcast(found), totals["rows"], totals["nulls"], totals["all"])


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows of ``df`` to a table that has at most one row per key.

    The few table rows of hot keys go to every executor, so the many rows of
    ``df`` that need them are not shuffled. In a left join rows without a key
    stay where they are as well.
    """
    keys = list(keys)
    limit = max_group_rows(df)
    hot = hot_keys(df, keys, limit)
    parts = []
    if hot.null_rows > limit:
        if how == "left":
            added = [f for f in table.schema.fields if f.name not in keys]
            parts.append(df.where(_any_null(keys)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}))
        df = df.where(~_any_null(keys))
    if hot.keys is not None:
        # one table row per hot key
        few = F.broadcast(table.join(hot.keys, keys, "left_semi"))
        parts.append(df.join(hot.keys, keys, "left_semi").join(few, keys, how))
        df = df.join(hot.keys, keys, "left_anti")
    parts.append(df.join(table, keys, how))
    return reduce(DataFrame.unionByName, parts)
