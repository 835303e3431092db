"""Block-wise windows must equal the plain Spark windows."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchframe.plans import ordered


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        # one key holds half of all rows, a date repeats often and may be missing
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(30)}"
        day = None if rnd.random() < 0.1 else rnd.randrange(25)
        data.append((i, key, day, None if rnd.random() < 0.2 else float(rnd.randrange(90)), rnd.random() < 0.4))
    return spark.createDataFrame(data, "id int, key string, day int, x double, flag boolean").cache()


def _plain(table, frame):
    w = Window.partitionBy("key").orderBy(F.col("day").asc_nulls_last(), "id")
    return w.rowsBetween(*frame)


@pytest.mark.parametrize("n", [1, 3, 8, 100])
def test_rolling_equals_plain_window(table, tiny_groups, n):
    groups = ordered.ordered_groups(table, ["key"], ["day", "id"])
    assert groups.split
    cols = lambda w: {"avg": F.avg("x").over(w), "ids": F.collect_list("id").over(w)}
    got = groups.rolling(n, cols, reads=["x", "id"]).result()
    want = table.withColumns(cols(_plain(table, (-n, -1))))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_plain_window(table, tiny_groups, inclusive):
    aggs = {
        "s": ("sum", F.coalesce("x", F.lit(0.0))),
        "c": ("count", F.col("x")),
        "m": ("max", F.when(F.col("flag"), F.struct("day", "id"))),
    }
    got = ordered.ordered_groups(table, ["key"], ["day", "id"]).running(aggs, inclusive=inclusive).result()
    w = _plain(table, (Window.unboundedPreceding, 0 if inclusive else -1))
    want = table.withColumns(
        {
            "s": F.coalesce(F.sum(aggs["s"][1]).over(w), F.lit(0.0)),
            "c": F.count("x").over(w),
            "m": F.max(aggs["m"][1]).over(w),
        }
    )
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_whole_table_as_one_group(table, tiny_groups):
    got = ordered.ordered_groups(table, [], ["day", "id"]).running(
        {"rn": ("count", F.lit(1))}, inclusive=True
    ).result()
    ids = [r.id for r in got.orderBy("rn").collect()]
    want = [r.id for r in table.orderBy(F.col("day").asc_nulls_last(), "id").collect()]
    assert ids == want
    assert set(got.columns) == {*table.columns, "rn"}


def test_blocks_stay_small(table, tiny_groups):
    groups = ordered.ordered_groups(table, ["key"], ["day", "id"])
    hot = groups.frame.where("__block > 0")
    largest = hot.groupBy("key", "__block").count().agg(F.max("count")).first()[0]
    assert hot.select("__block").distinct().count() > 8
    assert largest <= 80


def test_small_groups_use_one_plain_window(table):
    groups = ordered.ordered_groups(table, ["key"], ["day", "id"])
    assert not groups.split and groups.result().columns == table.columns
