import datetime as dt
import math
import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.operators import ratings

FOUR = [("Arsenal", "Chelsea", 2, 0), ("Chelsea", "Liverpool", 1, 1), ("Liverpool", "Arsenal", 0, 2), ("Arsenal", "Liverpool", 3, 1)]
GAMES = "home_team string, away_team string, home_goals int, away_goals int"


def _season(spark, n=120, teams=8, seed=3, missing=0.1):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        h, a = rnd.sample(range(teams), 2)
        goals = [None, None] if rnd.random() < missing else [rnd.randrange(4), rnd.randrange(3)]
        day = dt.datetime(2024, 8, 1) + dt.timedelta(days=i // 3)
        data.append((f"f{i:04d}", day, f"T{h}", f"T{a}", *map(lambda g: None if g is None else float(g), goals)))
    return spark.createDataFrame(data, "fixture_id string, date timestamp_ntz, home_team string, away_team string, home_goals double, away_goals double")


def test_two_observations_per_played_fixture(spark):
    df = spark.createDataFrame([("Arsenal", "Chelsea", 2, 1), ("A", "B", None, 1)], GAMES)
    got = sorted(map(tuple, ratings.poisson_observations(df).collect()))
    assert got == [("Arsenal", "Chelsea", 1, 2.0), ("Chelsea", "Arsenal", 0, 1.0)]


def test_fit_of_four_fixtures(spark):
    fitted = ratings.fit_poisson_ratings(spark.createDataFrame(FOUR, GAMES), [], sweeps=500)
    got = {r.team: r for r in fitted.collect()}
    want = {"Arsenal": (1.455846, 0.347844), "Chelsea": (0.436417, 1.047377), "Liverpool": (1.107737, 1.604778)}
    assert got.keys() == want.keys()
    for team, (attack, defense) in want.items():
        assert abs(got[team].attack - attack) < 2e-6 and abs(got[team].defense - defense) < 2e-6
    assert abs(got["Arsenal"].home_advantage - 1.223109) < 2e-6


@pytest.mark.parametrize("home_field_advantage", [True, False])
def test_distributed_sweeps_equal_sweeps_in_task(spark, home_field_advantage):
    df = _season(spark).withColumn("season", F.when(F.col("fixture_id") < "f0050", "a"))
    run = lambda cells: {
        (r.season, r.team): (r.attack, r.defense, r.home_advantage)
        for r in ratings._fitted_ratings(df, ["season"], home_field_advantage, 2, ratings.TOLERANCE, cells).collect()
    }
    inside, spread = run(ratings.MAX_GROUP_CELLS), run(1)
    assert inside.keys() == spread.keys() and len(inside) == 16
    assert max(abs(x - y) for k in inside for x, y in zip(inside[k], spread[k])) < 1e-12


@pytest.mark.parametrize("cells", [ratings.MAX_GROUP_CELLS, 1])
def test_too_little_data_gives_defaults(spark, cells):
    df = spark.createDataFrame([("A", "B", 2, 0), ("B", "A", None, None)], GAMES)
    got = ratings.fit_poisson_ratings(df, [], sweeps=1, max_group_cells=cells).collect()
    assert {(r.team, r.attack, r.defense, r.home_advantage) for r in got} == {("A", 1.0, 1.0, 1.25), ("B", 1.0, 1.0, 1.25)}


def test_fit_reproduces_goals_and_linear_model(spark):
    df = _season(spark, missing=0.0)
    fitted = {r.team: r for r in ratings.fit_poisson_ratings(df, [], sweeps=200).collect()}
    assert abs(np.mean([r.attack for r in fitted.values()]) - 1) < 1e-12
    glr = {r.team: r for r in ratings.fit_poisson_ratings_glr(df).collect()}
    for team, r in fitted.items():
        assert abs(r.attack - glr[team].attack) < 1e-6 and abs(r.home_advantage - glr[team].home_advantage) < 1e-6
    games = df.collect()
    mu = {True: 0.0, False: 0.0}
    scored = {t: 0.0 for t in fitted}
    expect = dict(scored)
    for g in games:
        for home, t, o, n in ((True, g.home_team, g.away_team, g.home_goals), (False, g.away_team, g.home_team, g.away_goals)):
            m = fitted[t].attack * fitted[o].defense * (fitted[t].home_advantage if home else 1)
            mu[home] += m
            scored[t] += n
            expect[t] += m
    base = sum(scored.values()) / sum(mu.values())
    assert max(abs(scored[t] - base * expect[t]) for t in scored) < 1e-6


def _rolled(df, **options):
    names = [*ratings.RATING_COLUMNS, "expected_home_goals", "expected_away_goals"]
    return {r.fixture_id: tuple(r[c] for c in names) for r in ratings.rolling_ratings(df, **options).collect()}


def test_window_of_two_has_no_leakage(spark):
    df = spark.createDataFrame(
        [("f1", "2024-08-16", "Arsenal", "Wolves", 1, 0), ("f2", "2024-08-20", "Arsenal", "Chelsea", 5, 0), ("f3", "2024-08-25", "Chelsea", "Arsenal", 0, 1)],
        "fixture_id string, date string, " + GAMES,
    )
    got = {r.fixture_id: r for r in ratings.rolling_ratings(df, window=2).collect()}
    assert got["f1"].home_attack_rating == 1.0
    assert got["f3"].away_attack_rating > got["f2"].home_attack_rating
    assert (got["f1"].expected_home_goals, got["f1"].expected_away_goals) == (1.509, 1.207)


def _slow_windows(df, window, sweeps, prior=ratings.PRIOR_GOALS):
    """The window fit written per fixture in plain Python."""
    games = sorted(df.collect(), key=lambda g: (g.date, g.fixture_id))
    result = {}
    for i, now in enumerate(games):
        chosen = set()
        for team in (now.home_team, now.away_team):
            chosen |= {j for j in range(i) if team in (games[j].home_team, games[j].away_team)} & set(
                [j for j in range(i) if team in (games[j].home_team, games[j].away_team)][-window:]
            )
        subset = [games[j] for j in sorted(chosen)]
        obs = []
        for g in subset:
            if g.home_goals is not None:
                obs += [(g.home_goals, 1, g.home_team, g.away_team), (g.away_goals, 0, g.away_team, g.home_team)]
        names = {t for g in subset for t in (g.home_team, g.away_team)}
        A, D, V = {t: 1.0 for t in names}, {t: 1.0 for t in names}, {1: 1.0}
        base = sum(o[0] for o in obs) / max(len(obs), 1)
        if len(obs) < 4:
            result[now.fixture_id] = (1.0, 1.0, 1.0, 1.0)
            continue

        def update(factors, key):
            for name in factors:
                mine = [o for o in obs if o[key] == name]
                seen = sum(o[0] for o in mine)
                mu = sum(base * V.get(o[1], 1.0) * A[o[2]] * D[o[3]] for o in mine)
                factors[name] *= (seen + prior) / (mu + prior * factors[name])

        for _ in range(sweeps):
            update(V, 1), update(A, 2), update(D, 3)
        ma, md = sum(A.values()) / len(A), sum(D.values()) / len(D)
        h, a = now.home_team, now.away_team
        one = lambda f, t, m: f[t] / m if t in f else 1.0
        result[now.fixture_id] = (one(A, h, ma), one(D, h, md), one(A, a, ma), one(D, a, md))
    return result


@pytest.mark.parametrize("window", [2, 5])
def test_windows_equal_plain_python(spark, window):
    # few teams: the two teams of a fixture often met within the window
    df = _season(spark, n=60, teams=4, seed=9)
    got, want = _rolled(df, window=window, sweeps=6), _slow_windows(df, window, 6)
    assert got.keys() == want.keys()
    assert max(abs(x - y) for k in want for x, y in zip(got[k][:4], want[k])) < 1e-9


def test_split_groups_order_and_future_do_not_matter(spark, tiny_groups):
    df = _season(spark, n=120, teams=4)
    assert df.groupBy("home_team").count().agg(F.max("count")).first()[0] > 20
    split = _rolled(df, sweeps=3)
    spark.conf.unset("spark.pitchframe.maxGroupRows")
    whole = _rolled(df.orderBy(F.rand(1)), sweeps=3)
    assert split == whole
    past = _rolled(df.where("fixture_id < 'f0060'"), sweeps=3)
    assert len(past) == 60 and all(whole[k] == v for k, v in past.items())


def test_renaming_teams_changes_nothing(spark):
    df = _season(spark, n=60)
    renamed = df.withColumns({c: F.concat(F.lit("x"), F.translate(c, "T01234567", "T76543210")) for c in ("home_team", "away_team")})
    a, b = _rolled(df, sweeps=5), _rolled(renamed, sweeps=5)
    assert all(math.isclose(x, y, abs_tol=1e-9) for k in a for x, y in zip(a[k], b[k]))


def test_unknown_teams_and_self_match(spark):
    df = _season(spark, n=20, teams=4, missing=0.0)
    odd = spark.createDataFrame([("x1", dt.datetime(2025, 1, 1), None, "T1", 1.0, 1.0), ("x2", dt.datetime(2025, 1, 2), "T2", "T2", None, None)], df.schema)
    got = _rolled(df.union(odd))
    assert len(got) == 22 and got["x1"][0] == 1.0 and got["x2"][0] == got["x2"][2]


def test_window_members_and_latest(spark):
    df = _season(spark, n=60, teams=4)
    games = sorted(df.collect(), key=lambda g: (g.date, g.fixture_id))
    want = set()
    for i, now in enumerate(games):
        for t in (now.home_team, now.away_team):
            want |= {(now.fixture_id, g.fixture_id) for g in [g for g in games[:i] if t in (g.home_team, g.away_team)][-3:]}
    assert sorted(map(tuple, ratings.rating_window_members(df, 3).collect())) == sorted(want)
    last = ratings.team_last_n(df, 3)
    assert last.groupBy("team").count().where("count = 3").count() == 4
    assert last._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_one_large_group_among_small_ones(spark):
    df = _season(spark).withColumn("season", F.when(F.col("fixture_id") < "f0010", "a"))
    run = lambda cells: {
        (r.season, r.team): (r.attack, r.defense, r.home_advantage)
        for r in ratings._fitted_ratings(df, ["season"], True, 2, ratings.TOLERANCE, cells).collect()
    }
    sizes = sorted(r["count"] for r in ratings.rating_cells(df, ["season"]).groupBy("season").count().collect())
    assert sizes[0] < sizes[-1]
    inside, mixed = run(ratings.MAX_GROUP_CELLS), run(sizes[0])
    assert inside.keys() == mixed.keys()
    assert max(abs(x - y) for k in inside for x, y in zip(inside[k], mixed[k])) < 1e-12


def test_more_sweeps_move_no_window(spark):
    df = _season(spark, n=150, teams=6, seed=3)
    once, twice = _rolled(df, sweeps=ratings.SWEEPS), _rolled(df, sweeps=2 * ratings.SWEEPS)
    assert max(abs(x - y) for k in once for x, y in zip(once[k], twice[k])) < 1e-6
    flags = lambda **options: {r.ratings_converged for r in ratings.rolling_ratings(df, **options).collect()}
    assert flags() == {True} and flags(sweeps=2) == {True, False}
    with pytest.raises(ValueError):
        ratings.rolling_ratings(df, prior=0.0)


def test_groups_that_do_not_converge_have_empirical_ratings(spark):
    df = _season(spark, n=80).withColumn("season", F.when(F.col("fixture_id") < "f0006", "a").when(F.col("fixture_id") > "f0040", "b"))
    for cells, tries in ((ratings.MAX_GROUP_CELLS, (3, ratings.SWEEPS)), (1, (3,))):
        for sweeps in tries:
            fitted = ratings.fit_poisson_ratings(df, sweeps=sweeps, max_group_cells=cells).collect()
            states = {r.season: r.converged for r in fitted}
            assert set(states) == {"a", "b", None} and states["b"] == states[None] == (sweeps > 3)
            # Of six fixtures some factors run to nought, ever more slowly.
            assert not states["a"]
            means = {(r.season, r.team): (r.attack, r.defense) for r in ratings.empirical_ratings(df).collect()}
            ratio = {r.season: r.home_advantage for r in ratings.empirical_home_advantage(df).collect()}
            for r in fitted:
                if not r.converged:
                    assert (r.attack, r.defense) == pytest.approx(means[r.season, r.team]) and r.home_advantage == pytest.approx(ratio[r.season])
            assert len(fitted) == len(means)
    # With no columns to group by, too.
    whole = ratings.fit_poisson_ratings(df, [], sweeps=1).collect()
    assert {r.converged for r in whole} == {False} and set(whole[0].asDict()) == {"team", "attack", "defense", "home_advantage", "converged"}


def test_distributed_sweeps_leave_few_tables(spark):
    import os

    from pitchframe.plans.scratch import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    ratings.fit_poisson_ratings(_season(spark, n=40), [], sweeps=6, max_group_cells=1).count()
    assert len(set(os.listdir(folder)) - before) < 8


def test_strengths_know_neither_the_future_nor_the_own_result(spark):
    df = _season(spark, n=90, teams=5).withColumn("season", F.when(F.col("fixture_id") < "f0070", "a").otherwise("b"))
    names = [f"{r}_{k}" for r in ("home", "away") for k in ("attack", "defense")] + ["home_advantage"]
    known = lambda rows: {r.fixture_id: tuple(r[c] for c in names) for r in ratings.asof_strengths(rows).collect()}
    whole = known(df)
    for cut in ("f0030", "f0075"):
        day = df.where(F.col("fixture_id") == cut).first().date
        past = df.where(F.col("date") <= day).withColumns({c: F.when(F.col("date") < day, F.col(c)) for c in ("home_goals", "away_goals")})
        got = known(past)
        assert got and all(whole[k] == v for k, v in got.items())
    # Plain means of the matches before, on earlier dates of the season.
    games = df.collect()
    for now in games:
        past = [g for g in games if g.season == now.season and g.date < now.date and None not in (g.home_goals, g.away_goals)]
        sides = [(g.home_team, g.home_goals, g.away_goals) for g in past] + [(g.away_team, g.away_goals, g.home_goals) for g in past]
        mine = [s for s in sides if s[0] == now.home_team]
        mean = sum(s[1] for s in sides) / len(sides) if sides else 0
        want = (sum(s[1] for s in mine) / len(mine) / mean, sum(s[2] for s in mine) / len(mine) / mean) if mine and mean else (1.0, 1.0)
        assert whole[now.fixture_id][:2] == pytest.approx(want)


def test_strengths_of_odd_fixtures(spark, tiny_groups):
    df = _season(spark, n=60, teams=4).withColumn("season", F.lit(None).cast("string"))
    odd = spark.createDataFrame([("x1", None, "T1", "T2", 1.0, 1.0, None), ("x2", dt.datetime(2030, 1, 2), None, "T2", None, None, None)], df.schema)
    got = {r.fixture_id: r for r in ratings.asof_strengths(df.union(odd)).collect()}
    assert len(got) == 62 and got["x1"].home_attack == 1.0 and got["x1"].home_advantage == 1.25
    assert got["x2"].home_attack == 1.0 and got["x2"].away_attack != 1.0
    assert ratings.asof_strengths(df.limit(0)).collect() == []


def test_histories_are_never_broadcast_nor_grouped_by_few_tasks(spark, monkeypatch):
    from pitchframe.plans import ordered, skew

    df = _season(spark, n=120, teams=4)
    whole = _rolled(df, sweeps=3)
    rated = ratings.rolling_ratings(df, sweeps=3)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # tiny tasks: more of them, the same results
    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    monkeypatch.setattr(ordered, "TASK_ROWS", 5)
    assert "hashpartitioning(fixture_id, 48)" in re.sub(r"#\d+", "", ratings.rolling_ratings(df, sweeps=3)._jdf.queryExecution().executedPlan().toString())
    many = _rolled(df, sweeps=3)
    assert many.keys() == whole.keys() and all(many[k] == pytest.approx(v, abs=1e-12) for k, v in whole.items())


def test_newton_steps_end_where_sweeps_end(spark, monkeypatch):
    df = _season(spark, n=150, teams=5, seed=4)
    odd = spark.createDataFrame(
        [("x1", dt.datetime(2025, 1, 1), None, "T1", 1.0, 1.0), ("x2", dt.datetime(2025, 1, 2), "T2", "T2", 3.0, 1.0), ("x3", dt.datetime(2025, 1, 3), "T2", "T1", None, None)], df.schema
    )
    df = df.union(odd)
    far = _slow_windows(df.where("fixture_id < 'f0100'"), 8, 400)
    got = _rolled(df)
    assert max(abs(x - y) for k in far for x, y in zip(got[k][:4], far[k])) < 1e-9
    # sixteen sweeps suffice for every window, odd ones too
    assert {r.ratings_converged for r in ratings.rolling_ratings(df, sweeps=16).collect()} == {True}


def test_windows_fitted_a_few_at_once_are_the_same(spark, monkeypatch):
    columns = ["fixture_id", *ratings.RATING_COLUMNS, "expected_home_goals", "ratings_converged"]
    got = {}
    for at_once in (7, 100_000):
        monkeypatch.setattr(ratings, "FIT_WINDOWS", at_once)
        got[at_once] = sorted(tuple(r) for r in ratings.rolling_ratings(_season(spark), 5).select(*columns).collect())
    assert len(got[7]) == 120 and all(r[-1] for r in got[7])
    for few, all_ in zip(got[7], got[100_000]):
        assert few[0] == all_[0] and max(abs(a - b) for a, b in zip(few[1:6], all_[1:6])) < 1e-9
