"""Lookups that spread hot keys must equal plain joins."""
import random

import pytest
from pyspark.sql import functions as F

from pitchframe.operators import clean
from pitchframe.plans import skew


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_join(spark, tiny_groups, how):
    rnd = random.Random(1)
    # a third of the rows has one key, another third none
    keys = [rnd.choice(["hot", None, f"k{rnd.randrange(60)}"]) for _ in range(500)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, key string")
    table = spark.createDataFrame([("hot", 1.0), *[(f"k{i}", float(i)) for i in range(40)]], "key string, value double")
    found = skew.hot_keys(df, ["key"], 40)
    assert [tuple(r) for r in found.keys.collect()] == [("hot",)] and found.null_rows > 40
    got = skew.lookup(df, table, ["key"], how)
    want = df.join(table, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_alias_table_with_hot_team(spark, tiny_groups):
    df = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, " Wolves ").otherwise(F.concat(F.lit("T"), "id")).alias("home_team"))
    aliases = spark.createDataFrame([("Wolves", "Wolverhampton Wanderers")], "alias string, canonical string")
    got = clean.standardize_teams(df, aliases=aliases)
    assert got.count() == 300 and got.where("home_team = 'Wolverhampton Wanderers'").count() == 150
