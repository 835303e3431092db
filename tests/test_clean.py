import datetime as dt

from pyspark.sql import functions as F

from pitchframe.operators import clean
from pitchframe.operators.profile import describe, missing_profile, validate_fixtures

CANONICAL = [
    ("Man United", "Manchester United"), ("Manchester Utd", "Manchester United"), ("Wolves", "Wolverhampton Wanderers"),
    ("Leicester", "Leicester City"), ("Brighton", "Brighton & Hove Albion"), (" Brighton\t", "Brighton & Hove Albion"),
    ("Arsenal", "Arsenal"), (" Unknown FC ", "Unknown FC"), (None, None),
]


def test_team_names_from_mapping_and_from_table(spark):
    df = spark.createDataFrame([(a, a, a, b) for a, b in CANONICAL], "home_team string, away_team string, other_col string, want string")
    table = spark.createDataFrame([("Man United", "Manchester United"), ("Wolves", "Wolverhampton Wanderers")], "alias string, canonical string")
    got = clean.standardize_teams(df)
    assert got.where(~(F.col("home_team").eqNullSafe(F.col("want")) & F.col("away_team").eqNullSafe(F.col("want")))).count() == 0
    assert sorted(map(str, got.select("other_col").collect())) == sorted(map(str, df.select("other_col").collect()))
    assert clean.standardize_teams(df, ["home_team"]).where("away_team <=> other_col").count() == len(CANONICAL)
    named = {r.other_col: r.home_team for r in clean.standardize_teams(df, aliases=table).collect()}
    assert named["Wolves"] == "Wolverhampton Wanderers" and named[" Brighton\t"] == "Brighton" and named[None] is None


def test_differentials(spark):
    df = spark.createDataFrame(
        [(2, 1, 1.8, 0.9, 12, 6, 5, 3), (1, 1, 0.5, 1.2, 8, 10, 2, 4)],
        "home_goals int, away_goals int, home_xg double, away_xg double, home_shots int, away_shots int, home_sot int, away_sot int",
    )
    got = [tuple(round(v, 9) for v in r) for r in clean.base_differentials(df).select("goals_diff", "xg_diff", "shots_diff", "sot_diff").collect()]
    assert got == [(1, 0.9, 6, 2), (0, -0.7, -2, -2)]
    assert clean.base_differentials(df.drop("home_xg")).select("xg_diff").distinct().collect() == [(None,)]


RAW = [
    ("fix2", "2024-08-20", "Man United", "Fulham", 1, 0, 1.4, 0.4),
    ("fix1", "2024-08-16", "Arsenal", "Wolves", 2, 0, None, None),
]
SCHEMA = "fixture_id string, date string, home_team string, away_team string, home_goals int, away_goals int, home_xg double, away_xg double"


def test_cleaning_stage(spark):
    got = clean.clean_fixtures(spark.createDataFrame(RAW, SCHEMA), ordered=True).collect()
    assert [r.fixture_id for r in got] == ["fix1", "fix2"]
    assert got[0].away_team == "Wolverhampton Wanderers" and got[0].is_xg_missing and got[0].date == dt.datetime(2024, 8, 16)
    assert not got[1].is_xg_missing and got[1].goals_diff == 1 and round(got[1].xg_diff, 9) == 1.0 and got[1].shots_diff is None


def test_statistics_fill_missing_values_only(spark):
    stats = spark.createDataFrame(
        [("fix1", "Arsenal", "a", None, 9, 3), ("fix1", "Arsenal", "b", 1.1, 8, 2), ("fix1", "Wolves", "a", 0.6, 4, None), ("fix2", "Manchester Utd", "a", 9.9, 7, 1)],
        "fixture_id string, team string, match_report string, xg double, shots int, sot int",
    )
    got = {r.fixture_id: r for r in clean.clean_fixtures(spark.createDataFrame(RAW, SCHEMA), stats).collect()}
    one, two = got["fix1"], got["fix2"]
    assert (one.home_xg, one.away_xg, one.home_shots, one.away_sot) == (1.1, 0.6, 9, None)
    assert not one.is_xg_missing and two.home_xg == 1.4 and two.home_shots == 7 and two.away_shots is None


def test_profiles(spark):
    df = clean.with_xg_flag(spark.createDataFrame(RAW, SCHEMA))
    assert {r.column: r.rows for r in missing_profile(df).collect()} == {"home_xg": 1, "away_xg": 1, "is_xg_missing = true": 1}
    assert tuple(validate_fixtures(df.drop("date")).first()) == (2, 2, "date")


def test_describe_matches_pandas(spark):
    values = [(float(v * v % 17) / 3, None if v % 5 == 0 else float(v)) for v in range(50)]
    df = spark.createDataFrame(values, "a double, b double")
    want = df.toPandas().describe()
    for r in describe(df, ["a", "b"]).collect():
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert max(abs(x - y) for x, y in zip(got, want[r["column"]])) < 1e-9
