"""Windows over ordered groups whose largest group need not fit one task.

``Window.partitionBy(team).orderBy(date)`` sends a whole team to one task. That
is the right plan while every group is small, so it is used after a count per
key has shown that no group exceeds the row limit. Groups beyond the limit are
range-partitioned on (key, order), which cuts them into consecutive blocks, and
the blocks are stored. A frame of the last N rows then needs only the last N
rows before its block, a running aggregate only the aggregate of the blocks
before it. Both are small tables, so every task keeps at most one block.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitchframe.plans.scratch import written
from pitchframe.plans.skew import TASK_ROWS, hot_keys, max_group_rows, tasks_for

# Most blocks cut from the oversized groups. It bounds the per-block tables that
# are broadcast or windowed per key; larger inputs get larger blocks.
MAX_BLOCKS = 50_000

_BLOCK = "__block"
_HALO = "__halo"
_ALL = "__all"


def nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


@dataclass(frozen=True)
class OrderedGroups:
    """A table together with the grouping under which its windows run."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    rows: int = 0

    @property
    def _partition(self) -> list[str]:
        return [*self.keys, _BLOCK] if self.split else list(self.keys)

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self._partition).orderBy(*nulls_last(self.order))

    def rolling(
        self,
        n: int,
        columns: Callable[[WindowSpec], dict[str, Column]],
        reads: Sequence[str],
    ) -> OrderedGroups:
        """Add columns computed over the ``n`` rows before the current one.

        ``reads`` names the columns the frame expressions look at; only those
        are copied from one block to the next.
        """
        frame = self.frame
        if self.split:
            frame = frame.withColumn(_HALO, F.lit(False)).unionByName(
                self._last_rows_before_each_block(n, reads), allowMissingColumns=True
            )
            frame = _dealt(frame, self._partition, self.rows)
        frame = frame.withColumns(columns(self._window().rowsBetween(-n, -1)))
        if self.split:
            frame = frame.where(~F.col(_HALO)).drop(_HALO)
        return self.with_frame(frame)

    def running(
        self, columns: dict[str, tuple[str, Column]], *, inclusive: bool = False
    ) -> OrderedGroups:
        """Add running aggregates ``{name: (kind, value)}``, kind one of sum, max, count.

        The frame holds all earlier rows of the group, with ``inclusive`` also
        the current one. A sum or count over no rows is 0, a max is null.
        """
        w = self._window().rowsBetween(
            Window.unboundedPreceding, Window.currentRow if inclusive else -1
        )
        frame = self.frame.withColumns(
            {name: _aggregate(kind, value).over(w) for name, (kind, value) in columns.items()}
        )
        if self.split:
            frame = frame.join(
                F.broadcast(self._carried_aggregates(columns)), [*self.keys, _BLOCK], "left"
            )
            frame = frame.withColumns(
                {name: _combine(kind, F.col(name), F.col(f"__{name}")) for name, (kind, _) in columns.items()}
            ).drop(*[f"__{name}" for name in columns])
        zeros = {n: F.coalesce(n, F.lit(0)) for n, (kind, _) in columns.items() if kind != "max"}
        return self.with_frame(frame.withColumns(zeros) if zeros else frame)

    def result(self) -> DataFrame:
        return self.frame.drop(_BLOCK, _ALL)

    def with_frame(self, frame: DataFrame) -> OrderedGroups:
        return OrderedGroups(frame, self.keys, self.order, self.split, self.rows)

    def _last_rows_before_each_block(self, n: int, reads: Sequence[str]) -> DataFrame:
        # At most n rows per (key, block) survive, at most MAX_BLOCKS blocks per key.
        backwards = Window.partitionBy(*self._partition).orderBy(
            *[F.col(c).desc_nulls_first() for c in self.order]
        )
        kept = list(dict.fromkeys([*self.order, *reads]))
        kept = [c for c in kept if c not in self.keys]
        tails = (
            self.frame.where(F.col(_BLOCK) > 0)
            .withColumn("__back", F.row_number().over(backwards))
            .where(F.col("__back") <= n)
            .groupBy(*self._partition)
            .agg(
                F.reverse(F.sort_array(F.collect_list(F.struct("__back", *kept)))).alias("__tail")
            )
        )
        before = Window.partitionBy(*self.keys).orderBy(_BLOCK).rowsBetween(-n, -1)
        gathered = F.flatten(F.collect_list("__tail").over(before))
        return (
            tails.withColumn("__gathered", gathered)
            .select(
                *self._partition,
                F.inline(
                    F.slice("__gathered", F.greatest(F.lit(1), F.size("__gathered") - (n - 1)), n)
                ),
            )
            .drop("__back")
            .withColumn(_HALO, F.lit(True))
        )

    def _carried_aggregates(self, columns: dict[str, tuple[str, Column]]) -> DataFrame:
        # One row per (key, block) of the split groups: at most MAX_BLOCKS + MAX_HOT_KEYS.
        per_block = (
            self.frame.where(F.col(_BLOCK) > 0)
            .groupBy(*self._partition)
            .agg(*[_aggregate(kind, value).alias(f"__{n}") for n, (kind, value) in columns.items()])
        )
        before = Window.partitionBy(*self.keys).orderBy(_BLOCK).rowsBetween(
            Window.unboundedPreceding, -1
        )
        merged = {
            f"__{n}": (F.max if kind == "max" else F.sum)(f"__{n}").over(before)
            for n, (kind, _) in columns.items()
        }
        return per_block.withColumns(merged)


def _aggregate(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "count": F.count}[kind](value)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


def _dealt(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """Groups of a large table dealt over so many tasks that few of them meet in one."""
    if rows <= TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks_for(df, rows), *columns)


def ordered_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> OrderedGroups:
    """Group ``df`` by non-null ``keys`` (none: the whole table), ordered ascending, nulls last.

    The order must be total within a key. Counts the rows per key once, on the
    key columns alone, to decide whether groups have to be split.
    """
    keys, order = list(keys), list(order)
    if not keys:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    limit = max_group_rows(df)
    hot_groups = hot_keys(df, keys, limit)
    if hot_groups.keys is None:
        df = _dealt(df, keys, hot_groups.all_rows)
        return OrderedGroups(df, tuple(keys), tuple(order), False, hot_groups.all_rows)

    blocks = min(MAX_BLOCKS, max(2, math.ceil(2 * hot_groups.rows / limit)))
    # The block number is the range partition a row falls into. It is stored, as
    # a second evaluation of the plan could draw other partition bounds.
    hot = written(
        df.join(hot_groups.keys, keys, "left_semi")
        .repartitionByRange(blocks, *[F.col(k) for k in keys], *nulls_last(order))
        .withColumn(_BLOCK, F.spark_partition_id() + 1),
        "ordered-blocks",
    )
    cold = df.join(hot_groups.keys, keys, "left_anti").withColumn(_BLOCK, F.lit(0))
    return OrderedGroups(cold.unionByName(hot), tuple(keys), tuple(order), True, hot_groups.all_rows)
