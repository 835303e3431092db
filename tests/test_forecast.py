import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pitchframe.functions import numeric
from pitchframe.operators import calibrate, evaluate, features, forecast, profile


def test_outcomes_are_sums_of_the_grid(spark):
    df = spark.createDataFrame([("a", 1.4, 0.9), ("b", 0.0, 2.5), ("c", None, 1.0), ("d", 6.2, 4.0)], "fixture_id string, h double, a double")
    grid = forecast.scoreline_grid(df, "h", "a")
    assert grid.groupBy("fixture_id").count().where("count = 49").count() == 3
    cell = grid.where("fixture_id = 'a' and home_goals = 2 and away_goals = 1").first().probability
    assert abs(cell - math.exp(-2.3) * 1.4**2 / 2 * 0.9) < 1e-12
    share = lambda test: F.sum(F.when(test, F.col("probability")).otherwise(0.0)) / F.sum("probability")
    h, a = F.col("home_goals"), F.col("away_goals")
    want = {r[0]: tuple(r)[1:] for r in grid.groupBy("fixture_id").agg(share(h > a), share(h == a), share(h < a)).collect()}
    for r in forecast.outcome_probabilities(df, "h", "a").collect():
        got = (r.p_home, r.p_draw, r.p_away)
        if r.fixture_id == "c":
            assert got == (None, None, None)
        else:
            assert max(abs(x - y) for x, y in zip(got, want[r.fixture_id])) < 1e-12


def test_fixtures_are_dealt_before_they_become_scorelines(spark):
    df = spark.createDataFrame([(f"f{i}", i / 7, i / 5) for i in range(40)], "fixture_id string, h double, a double").coalesce(1)
    grid = forecast.scoreline_grid(df, "h", "a")
    used = grid.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    assert used.count() > 8 and grid.count() == 40 * 49


def test_blend_sums_to_one(spark):
    schema = "fixture_id string, p_home double, p_draw double, p_away double"
    a = spark.createDataFrame([("x", 0.5, 0.3, 0.2)], schema)
    b = spark.createDataFrame([("x", 0.2, 0.2, 0.2), ("y", 1.0, 0.0, 0.0)], schema)
    row, alone = forecast.blend_probabilities(a, b, (0.75, 0.25)).orderBy("fixture_id").collect()
    assert tuple(alone) == ("y", 1.0, 0.0, 0.0)
    assert abs(row.p_home + row.p_draw + row.p_away - 1) < 1e-12
    assert abs(row.p_home - (0.75 * 0.5 + 0.25 * 0.2) / (0.75 + 0.25 * 0.6)) < 1e-12


def test_no_home_goal_yet(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 1.0, 4.0)], "fixture_id string, attack double, v double")
    one = F.lit(1.0)
    home, away = numeric.expected_goals(one, one, F.col("attack"), one, F.col("v"))
    df = df.select("fixture_id", home.alias("expected_home_goals"), away.alias("expected_away_goals"))
    a, b, c = df.orderBy("fixture_id").collect()
    assert (a[1], a[2], b[1], c[1], c[2]) == (0.0, math.inf, 0.0, 2.7, 0.675) and math.isnan(b[2])
    assert all(math.isnan(r.p_away) == (r.fixture_id != "c") for r in forecast.outcome_probabilities(df).collect())
    assert forecast.scoreline_grid(df).count() == 3 * 49
    many = df.where("fixture_id != 'b'").union(df.where("fixture_id = 'a'")).union(df.where("fixture_id = 'a'"))
    got = profile.describe(many, ["expected_away_goals"]).first()
    assert (got["mean"], got["p50"], got["max"]) == (math.inf, math.inf, math.inf) and math.isnan(got["std"])


def test_absences_lower_expected_goals(spark):
    rated = spark.createDataFrame([("f", "A", "B", 2.0, 1.0)], "fixture_id string, home_team string, away_team string, expected_home_goals double, expected_away_goals double")
    runs = spark.createDataFrame([("f", "A", "GK", 1.0, 1), ("f", "A", "FWD", 0.5, 3)], "fixture_id string, team string, position_group string, starter_minute_share double, consecutive_missed int")
    row = forecast.adjusted_lambda(rated, runs, effect=0.1).first()
    load = 1.4 + 1.05 * 0.5 * 0.7**2
    assert abs(row.adjusted_home_goals - 2.0 * math.exp(-0.1 * load)) < 1e-12 and row.adjusted_away_goals == 1.0


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.2, 0.0), (1.0, 1.0), (0.0, 1.0), (None, 1.0)], "p double, y double")
    brier = evaluate.brier_score(df, "p", "y").first()
    assert brier.n == 4 and abs(brier.brier - (0.01 + 0.04 + 0 + 1) / 4) < 1e-12
    loss = evaluate.log_loss(df, "p", "y", clip=1e-3).first().log_loss
    assert abs(loss + (math.log(0.9) + math.log(0.8) + math.log(0.999) + math.log(1e-3)) / 4) < 1e-12
    bins = {r.bin: r.n for r in evaluate.reliability_bins(df, "p", "y").collect()}
    assert bins == {9: 2, 2: 1, 0: 1}


@pytest.mark.parametrize("split", [False, True])
def test_folds_are_chronological_and_expanding(spark, split, request):
    if split:
        request.getfixturevalue("tiny_groups")
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"f{i}", start + dt.timedelta(hours=i * 7 % 101)) for i in range(100)], "fixture_id string, date timestamp_ntz")
    rows = evaluate.walk_forward_folds(df, 30, 20).orderBy("date", "fixture_id").collect()
    assert [r.position for r in rows] == list(range(1, 101))
    assert [r.fold for r in rows] == [0] * 30 + [1] * 20 + [2] * 20 + [3] * 20 + [4] * 10
    assert {(r.fold, r.train_rows) for r in rows} == {(0, None), (1, 30), (2, 50), (3, 70), (4, 90)}


def test_recalibration_improves_a_distorted_forecast(spark):
    df = spark.range(4000).select(
        (F.rand(5) * 0.98 + 0.01).alias("true"), F.rand(6).alias("u")
    ).select(F.pow("true", 2).alias("p"), (F.col("u") < F.col("true")).cast("double").alias("y")).cache()
    before = evaluate.brier_score(df, "p", "y").first().brier
    curve = calibrate.isotonic(df, "p", "y")
    for scaled in (calibrate.platt_scaling(df, "p", "y"), curve):
        assert scaled.count() == 4000
        assert evaluate.brier_score(scaled, "calibrated", "y").first().brier < before
    fitted = [r.calibrated for r in curve.orderBy("p").select("calibrated").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(fitted, fitted[1:]))


@pytest.mark.parametrize("block_rows", [100_000, 7])
def test_isotonic_equals_pooling_by_hand(spark, block_rows):
    import random

    rng = random.Random(4)
    rows = [(i, round(rng.random(), 2), float(rng.random() < 0.5)) for i in range(300)] + [(300, None, 1.0), (301, 0.005, None), (302, 2.0, None)]
    df = spark.createDataFrame(rows, "i int, p double, y double")
    points = sorted({p for _, p, y in rows if p is not None and y is not None})
    blocks = []
    for x in points:
        ys = [y for _, p, y in rows if p == x and y is not None]
        blocks.append([[x], sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            xs, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + xs, blocks[-1][1] + s, blocks[-1][2] + n]
    want = {x: s / n for xs, s, n in blocks for x in xs}
    got = {r.i: r.calibrated for r in calibrate.isotonic(df, "p", "y", block_rows=block_rows).collect()}
    assert all(abs(got[i] - want[p]) < 1e-12 for i, p, _ in rows[:300])
    assert got[300] is None and abs(got[302] - max(want.values())) < 1e-12
    assert abs(got[301] - want[max([x for x in points if x <= 0.005], default=points[0])]) < 1e-12


FIXTURES = [
    ("f1", 1, "A", "B", 2.0, 0.0), ("f2", 4, "B", "A", 1.0, 1.0), ("f3", 9, "A", "C", 0.0, 3.0),
    ("f4", 9, "B", "D", None, None), ("f5", 20, "A", "B", 5.0, 0.0),
]


@pytest.fixture
def fixtures(spark):
    data = [(i, dt.datetime(2024, 8, d), h, a, x, y) for i, d, h, a, x, y in FIXTURES]
    return spark.createDataFrame(data, "fixture_id string, date timestamp_ntz, home_team string, away_team string, home_goals double, away_goals double")


def test_form_rest_and_meetings_look_back_only(fixtures):
    form = {r.fixture_id: r for r in features.team_features(fixtures).collect()}
    assert form["f1"].home_form_points is None and form["f1"].home_rest_days is None
    f5 = form["f5"]
    assert (f5.home_form_points, f5.away_form_points) == (4.0, 1.0)  # A: win, draw, loss; B: loss, draw, unplayed
    assert (f5.home_rest_days, f5.away_rest_days) == (11, 11)
    assert abs(f5.home_form_goals_for - 1.0) < 1e-12 and abs(f5.home_form_goals_against - 4 / 3) < 1e-12
    met = {r.fixture_id: r for r in features.head_to_head(fixtures).collect()}
    assert tuple(met["f5"])[1:] == (2, 1, 1, 0, 2.0) and tuple(met["f1"])[1:] == (0, 0, 0, 0, 0.0)
    assert tuple(met["f2"])[1:] == (1, 0, 0, 1, -2.0)


def test_rating_as_of_is_strictly_earlier(spark, fixtures):
    elo = spark.createDataFrame([("A", dt.datetime(2024, 8, 1), 1500.0), ("A", dt.datetime(2024, 8, 9), 1600.0), ("B", dt.datetime(2024, 8, 3), 1400.0)], "team string, date timestamp_ntz, elo double")
    got = {r.fixture_id: (r.home_elo, r.away_elo) for r in features.elo_asof(fixtures, elo).collect()}
    assert got == {"f1": (None, None), "f2": (1400.0, 1500.0), "f3": (1500.0, None), "f4": (1400.0, None), "f5": (1600.0, 1400.0)}
    missing = {(r.team, r.missing_in) for r in features.unmatched_teams(fixtures, elo).collect()}
    assert missing == {("C", "elo"), ("D", "elo")}


def test_every_fixture_keeps_its_row(spark):
    rows = [("f1", "2024-08-16", "A", "B"), ("f2", None, "A", "B"), ("f3", "2024-08-20", None, "B"), ("f4", "2024-08-21", None, None)]
    odd = spark.createDataFrame([(*r, 1, 0, 1.0, 0.5) for r in rows], "fixture_id string, date string, home_team string, away_team string, home_goals int, away_goals int, home_xg double, away_xg double")
    elo = spark.createDataFrame([("A", "2024-08-01", 1500.0)], "team string, date string, elo double")
    ids = ["f1", "f2", "f3", "f4"]
    asof = {r["fixture_id"]: r["home_elo"] for r in features.elo_asof(odd, elo).collect()}
    assert sorted(asof) == ids and asof["f1"] == 1500.0 and asof["f2"] is None
    for table in (features.head_to_head(odd), features.rolling_form(odd), features.rest_days(odd), features.team_features(odd)):
        assert sorted(r["fixture_id"] for r in table.collect()) == ids


def test_blend_keeps_fixtures_of_one_set(spark):
    schema = "fixture_id string, p_home double, p_draw double, p_away double"
    a = spark.createDataFrame([("x", 0.5, 0.3, 0.2), ("y", 0.2, 0.2, 0.6)], schema)
    b = spark.createDataFrame([("y", 0.2, 0.2, 0.6), ("z", 0.1, 0.1, 0.8)], schema)
    got = {r["fixture_id"]: round(r[1], 6) for r in forecast.blend_probabilities(a, b).collect()}
    assert got == {"x": 0.5, "y": 0.2, "z": 0.1}


def test_features_are_dealt_by_fixture_over_all_cores(spark):
    days = [dt.datetime(2024, 8, 1) + dt.timedelta(days=d) for d in range(80)]
    rows = [(f"f{i:03d}", day, f"T{i % 7}", f"T{7 + i % 5}", float(i % 3), float(i % 2)) for i, day in enumerate(days)]
    games = spark.createDataFrame(rows, "fixture_id string, date timestamp_ntz, home_team string, away_team string, home_goals double, away_goals double")
    elo = spark.createDataFrame([("T1", days[0], 1500.0)], "team string, date timestamp_ntz, elo double")
    for table in (features.team_features(games), features.elo_asof(games, elo)):
        used = table.select(F.spark_partition_id().alias("task")).groupBy("task").count()
        assert used.count() > 4 and table.count() == 80
