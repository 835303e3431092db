import datetime as dt

from pyspark.sql import functions as F

from pitchframe import schemas
from pitchframe.functions import numeric, text
from pitchframe.operators import absences


def test_position_groups(spark):
    cases = {"GK": "GK", "DF": "DEF", "DF,MF": "DEF", "MF,FW": "MID", "FW": "FWD", " fw ,MF": "FWD", "LWB": "MID", "": "MID", None: "MID"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string")
    assert df.where(text.position_group(F.col("p")) != F.col("want")).count() == 0


def test_absence_types(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "n int")
    got = [r[0] for r in df.select(numeric.absence_type(F.col("n"))).collect()]
    assert got == ["rotation_suspension", "injury", "injury"]


def _logs(spark, minutes, player="p1"):
    start = dt.datetime(2024, 8, 1)
    data = [(f"f{i + 1}", start + dt.timedelta(days=7 * i), "Arsenal", player, "N", "FW", m) for i, m in enumerate(minutes)]
    return spark.createDataFrame(data, schemas.PLAYER_LOGS)


def test_starter_absences(spark):
    got = absences.player_absences(_logs(spark, [90.0] * 5 + [0.0, 0.0])).orderBy("date").collect()
    assert [(r.fixture_id, r.absence_type, r.position_group) for r in got] == [
        ("f6", "rotation_suspension", "FWD"), ("f7", "injury", "FWD"),
    ]
    assert got[0].starter_minute_share == 1.0


def test_regular_starter_is_flagged_three_times(spark):
    got = absences.player_absences(_logs(spark, [90.0] * 5 + [0.0] * 6)).count()
    assert got == 3


def test_runs_restart_and_null_minutes_count_as_missed(spark):
    logs = _logs(spark, [0.0, None, 45.0, 0.0, None, 0.0]).union(_logs(spark, [None, 10.0], "p2")).union(_logs(spark, [0.0], None))
    got = [(r.player_id, r.consecutive_missed) for r in absences.consecutive_missed(logs).orderBy("player_id", "date").collect()]
    assert got == [("p1", 1), ("p1", 2), ("p1", 0), ("p1", 1), ("p1", 2), ("p1", 3), ("p2", 1), ("p2", 0)]


def test_share_skips_null_minutes(spark):
    got = [r.starter_minute_share for r in absences.starter_minute_share(_logs(spark, [None, 90.0, None, 45.0, 0.0])).orderBy("date").collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, 0.75]


def test_empty_logs_give_typed_empty_result(spark):
    got = absences.player_absences(schemas.empty(spark, schemas.PLAYER_LOGS))
    assert got.columns == schemas.ABSENCES.fieldNames() and got.count() == 0


def test_single_shuffle(spark):
    plan = absences.player_absences(_logs(spark, [90.0] * 7))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
