import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitchframe import schemas
from pitchframe.functions import numeric, text
from pitchframe.operators import clean, ingest
from pitchframe.plans.scratch import scratch_path
from pitchframe.sources import landed


def test_season_label(spark):
    df = spark.createDataFrame([("2024/2025",), ("2024-2025",), ("2024",), (None,), ("2024/2025\n",)], "s string")
    got = [r[0] for r in df.select(text.season_label(F.col("s"))).collect()]
    assert got == ["2024-2025", "2024-2025", None, None, None]


def test_season_label_strict_raises(spark):
    df = spark.createDataFrame([("2024",)], "s string")
    with pytest.raises(Exception, match="season must be"):
        df.select(text.season_label(F.col("s"), strict=True)).collect()


def test_normalize_schedule(spark):
    df = spark.createDataFrame(
        [("abc123", "2024-08-16", "Arsenal", "2–1", "Wolves")],
        "game_id string, date string, home_team string, score string, away_team string",
    )
    row = ingest.normalize_schedule(df).first()
    assert (row.fixture_id, row.home_goals, row.away_goals) == ("abc123", 2.0, 1.0)
    assert ingest.normalize_schedule(df.withColumnRenamed("game_id", "match_id")).columns[0] == "fixture_id"


@pytest.mark.parametrize(
    "score, plain, in_play",
    [("2–1", (2, 1), (2, 1)), ("(4) 1–1 (3)", (4, 1), (1, 1)), ("Postponed", (None, None), (None, None)), (None, (None, None), (None, None)), ("10:0", (10, 0), (10, 0))],
)
def test_parse_score(spark, score, plain, in_play):
    df = spark.createDataFrame([(score,)], "s string")
    assert tuple(df.select(*text.parse_score(F.col("s"))).first()) == plain
    assert tuple(df.select(*text.parse_score(F.col("s"), skip_brackets=True)).first()) == in_play


def test_stats_of_one_fixture_by_game(spark):
    df = spark.createDataFrame(
        [("L", "2425", "Arsenal", "abc123", 12), ("L", "2425", "Wolves", "abc123", 5), ("L", "2425", "Other", "other", 3)],
        "league string, season string, team string, game string, shots int",
    )
    got = ingest.match_stats_for_fixture(df, "abc123").collect()
    assert [r.fixture_id for r in got] == ["abc123", "abc123"] and {r.team for r in got} == {"Arsenal", "Wolves"}


def test_stats_of_one_fixture_by_link_is_literal(spark):
    df = spark.createDataFrame([("/m/a.c/x", 1), ("/m/abc/x", 2), (None, 3)], "match_report string, shots int")
    assert [r.shots for r in ingest.match_stats_for_fixture(df, "a.c").collect()] == [1]


def test_player_minutes(spark):
    df = spark.createDataFrame([("f1", "Player A", 90), ("f2", "Player B", 10)], "fixture_id string, player string, minutes int")
    assert [tuple(r) for r in ingest.player_minutes(df, "f1").collect()] == [("f1", "Player A", 90)]


def test_elo_snapshot(spark):
    day = lambda d: dt.datetime(2024, 8, d)
    df = spark.createDataFrame(
        [("Arsenal", day(10), 1790.0), ("Arsenal", day(16), 1800.0), ("Arsenal", day(20), 1810.0), ("Late", day(20), 1.0)],
        schemas.ELO,
    )
    assert [tuple(r) for r in ingest.elo_snapshot(df, "2024-08-16").collect()] == [("Arsenal", day(16), 1800.0)]
    assert {r.team: r.elo for r in ingest.elo_snapshot(df).collect()} == {"Arsenal": 1810.0, "Late": 1.0}


def test_round_trip_and_absent_folder(spark):
    path = scratch_path(spark, "nested/new")
    df = spark.createDataFrame([(1, "2024-2025"), (2, "2025-2026")], "fixture_id int, season string")
    landed.write_table(df, path, partition_by=["season"])
    back = landed.scan(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "2024-2025"), (2, "2025-2026")]
    plan = landed.of_season(back, "2024/2025")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    absent = landed.scan_or_empty(spark, path + "-absent", schemas.PLAYER_LOGS)
    assert absent.schema == schemas.PLAYER_LOGS and absent.count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_and_nan(spark, fmt):
    path = scratch_path(spark, fmt)
    df = spark.createDataFrame([("a", 1.5, 3), ("b", float("nan"), None)], "team string, xg double, shots bigint")
    landed.write_table(df, path, fmt=fmt)
    got = sorted(map(tuple, landed.scan(spark, path, df.schema, fmt).collect()))
    assert got == [("a", 1.5, 3), ("b", None, None)]


def test_row_wise_operators_accept_a_stream(spark):
    path = scratch_path(spark, "stream")
    df = spark.createDataFrame([("g1", "Wolves", "2–1", "Arsenal"), ("g2", "Leeds", None, "X")], "game_id string, home_team string, score string, away_team string")
    df.write.parquet(path)
    stream = clean.standardize_teams(ingest.normalize_schedule(spark.readStream.schema(df.schema).parquet(path)))
    query = stream.writeStream.format("memory").queryName("landed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.fixture_id, r.home_team, r.home_goals) for r in spark.table("landed").collect())
    assert got == [("g1", "Wolverhampton Wanderers", 2.0), ("g2", "Leeds United", None)]


def test_typing_by_content(spark):
    df = spark.createDataFrame(
        [("Arsenal", "2", "0", "1.5", "Postponed"), ("Chelsea", "1", "3", "0.8", ""), ("Liverpool", "", None, "2.1", "Fine")],
        "team string, GF string, GA string, xG string, notes string",
    )
    got = ingest.sanitize_match_stats(df)
    assert dict(got.dtypes) == {"team": "string", "GF": "bigint", "GA": "bigint", "xG": "double", "notes": "string"}
    assert [r.GF for r in got.orderBy("team").collect()] == [2, 1, None]
    assert [r.notes for r in got.orderBy("team").collect()] == ["Postponed", "", "Fine"]


def test_typing_leaves_typed_columns_and_suffixed_numbers(spark):
    df = spark.createDataFrame([("Arsenal", "2", 1, "1.5f"), ("B", "3", 1, "2d")], "team string, GF string, GA int, odd string")
    assert dict(ingest.sanitize_match_stats(df).dtypes) == {"team": "string", "GF": "bigint", "GA": "int", "odd": "string"}


def test_typing_share_is_inclusive(spark):
    rows = [("1",), ("2",), ("3",), ("4",), ("x",), (" ",), ("nan",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    assert ingest.infer_numeric(df) == {"v": "bigint"}
    assert ingest.infer_numeric(df.union(spark.createDataFrame([("y",)], "v string"))) == {}
    assert ingest.infer_numeric(df.limit(0)) == {}


def test_key_resolution_by_link_and_by_date(spark):
    day = dt.datetime(2024, 8, 16)
    fixtures = spark.createDataFrame([("f1", day, "A", "B"), ("f2", dt.datetime(2024, 8, 17), "A", "C")], "fixture_id string, date timestamp_ntz, home_team string, away_team string")
    stats = spark.createDataFrame(
        [("/matches/f2/x", day, "A", 1), (None, day, "B", 2), ("/other/", day, "A", 3), ("/matches/zz/x", day, "A", 4), (None, day, None, 5)],
        "match_report string, date timestamp_ntz, team string, shots int",
    )
    got = {r.shots: r.fixture_id for r in ingest.resolve_fixture_key(stats, fixtures).collect()}
    # 4 has a link of no fixture and is found by date and team
    assert got == {1: "f2", 2: "f1", 3: "f1", 4: "f1"}


def test_conforming_player_logs(spark):
    day = dt.datetime(2024, 8, 16)
    fixtures = spark.createDataFrame([("f1", day)], "fixture_id string, date timestamp_ntz")
    players = spark.createDataFrame([("f1", "X", "Player A", 90)], "fixture_id string, team string, player string, minutes int")
    got = ingest.conform_player_logs(players, fixtures)
    assert got.schema.fieldNames() == schemas.PLAYER_LOGS.fieldNames()
    assert tuple(got.first()) == ("f1", day, "X", "Player A|X", "Player A", None, 90.0)


def test_typing_keeps_every_digit_and_survives_overflow(spark):
    rows = [("9007199254740993", "1e20", "3.0"), ("-123456789012345678", "5", "+4")]
    typed = ingest.sanitize_match_stats(spark.createDataFrame(rows, "a string, b string, c string"))
    assert dict(typed.dtypes) == {"a": "bigint", "b": "double", "c": "bigint"}
    assert [tuple(r) for r in typed.orderBy("c").collect()] == [(9007199254740993, 1e20, 3), (-123456789012345678, 5.0, 4)]
    pinned = ingest.apply_types(spark.createDataFrame([("1e20",)], "a string"), {"a": "bigint"})
    assert pinned.first()["a"] is None


def test_fixture_is_found_under_another_name_or_an_unknown_link(spark):
    fixtures = spark.createDataFrame([("m1", "2024-08-16", "Manchester Utd", "Fulham")], "fixture_id string, date string, home_team string, away_team string")
    stats = spark.createDataFrame(
        [("Man United", None, "2024-08-16"), ("Fulham", "/en/matches/zzz/x", "2024-08-16"), ("Fulham", "/en/matches/m1/x", "2020-01-01"), ("Leeds", None, "2024-08-16")],
        "team string, match_report string, date string",
    )
    found = ingest.resolve_fixture_key(stats, fixtures)
    assert sorted((r["fixture_id"], r["team"], r["date"]) for r in found.collect()) == [("m1", "Fulham", "2020-01-01"), ("m1", "Fulham", "2024-08-16"), ("m1", "Man United", "2024-08-16")]


def test_players_without_a_name_have_no_id(spark):
    players = spark.createDataFrame([("f1", None, "A", 10), ("f1", "P", "A", 20)], "fixture_id string, player string, team string, minutes int")
    fixtures = spark.createDataFrame([("f1", "2024-08-16")], "fixture_id string, date string")
    got = {r["minutes_played"]: r["player_id"] for r in ingest.conform_player_logs(players, fixtures).collect()}
    assert got == {10: None, 20: "P|A"}


def test_season_filter_prunes_landed_folders(spark):
    path = scratch_path(spark, "seasons")
    df = spark.createDataFrame([("f1", "2023-2024"), ("f2", "2024-2025")], "fixture_id string, season string")
    landed.write_table(df, path, partition_by=["season"])
    one = landed.of_season(landed.scan(spark, path, df.schema), "2024/2025")
    assert [r["fixture_id"] for r in one.collect()] == ["f2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "2024-2025" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    with pytest.raises(ValueError, match="season must be"):
        landed.of_season(df, "2024")


def test_one_season_landed_again_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "fixtures")
    rows = [("f1", "a", 1), ("f2", "a", 2), ("f3", "b", 3), ("f4", None, 4)]
    df = spark.createDataFrame(rows, "fixture_id string, season string, goals int")
    landed.write_table(df, path, partition_by=["season"])
    landed.write_table(df.where("fixture_id = 'f3'").withColumn("goals", F.lit(9)), path, partition_by=["season"], others="keep")
    landed.write_table(df.limit(0), path, partition_by=["season"], others="keep")
    got = sorted(map(tuple, spark.read.parquet(path).select("fixture_id", "season", "goals").collect()))
    assert got == [("f1", "a", 1), ("f2", "a", 2), ("f3", "b", 9), ("f4", None, 4)]
    landed.write_table(df.where("season = 'a'"), path, partition_by=["season"])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        landed.write_table(df, path, others="keep")


def test_no_cast_fails_for_texts_of_digits_and_signs(spark):
    """A season or a date looks like a number at both ends; casting it would throw once a row."""
    good = {"1": 1.0, "-1.5": -1.5, "+.5": 0.5, "3.": 3.0, "2e3": 2000.0, "1E-2": 0.01, "00012": 12.0}
    bad = ["2023-2024", "2023/2024", "1,5", "1-2", "+", "1e", "0x1p3", "1.5f", "1\x00", "\x01" + "1", "1\n", "9:30"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = dict(df.select("t", numeric.number_of(F.col("t"))).collect())
    assert got == {**good, **{t: None for t in bad}}
    cast = df.where(F.col("t").rlike(numeric._DECIMAL)).select("t").collect()
    assert {r.t for r in cast} <= {*good, "1"}
